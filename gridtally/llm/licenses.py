"""License notices in texts, found by diagonal voting.

Every run of ``GRAM`` words of a text is hashed, with two independent hashes, and joined
to the positions that it has in the templates. A hit votes for its diagonal, the place in
the text where the template would start. Diagonals that neighbour each other, where words
were put in or left out, are merged to a band. A band is verified if its hits cover
``MIN_COVERAGE`` of the template's words and it is not much longer than the template.

Base places are the diagonals of a base phrase on which every run of the phrase has voted:
there its words stand consecutively. They count whatever the bands say.

The templates are a fixed table and are broadcast. Runs are hashed and joined in one pass
over the texts; only hits, and one row per document, are shuffled.

Cases: a NULL text is empty; it has no words and no labels. Documents are told apart by
id and text, and repeated rows each come back. NULL ids are allowed. Only ``doc_id`` and
``text`` are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtally.llm.common import let, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
MIN_COVERAGE = 0.85
#: Diagonals this far from each other are neighbours.
NEIGHBOURS = 2
#: A band may be so many times as long as its template, and some words more.
STRETCH, MORE_WORDS = 1.5, 2

# The phrases of the base and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# The opening words of public license notices.
NOTICES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files",
    ),
    ("mit", "licensed under the terms of the MIT license"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in "
        "compliance with the License",
    ),
    ("gpl-2", "GNU General Public License, version 2"),
    ("gpl-3", "GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
    ),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted",
    ),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("all-rights-reserved", "All rights reserved"),
)


def _hashes(words: list[Column]) -> Column:
    return F.struct(F.xxhash64(*words).alias("h"), F.hash(*words).alias("g"))


def template_grams(spark: SparkSession) -> DataFrame:
    """Every run of words of the templates: its hashes, template and place in it."""
    rows = []
    for number, (label, phrase) in enumerate(BASE + NOTICES):
        words = re.findall(WORD, phrase.lower())
        for at in range(len(words) - GRAM + 1):
            rows.append((number, label, number < len(BASE), len(words), at, words[at : at + GRAM]))
    table = spark.createDataFrame(
        rows, "template int, label string, base boolean, length int, at int, words array<string>"
    )
    hashes = _hashes([F.col("words")[i] for i in range(GRAM)])
    return table.select(hashes.alias("gram"), "template", "label", "base", "length", "at").select(
        "gram.*", "template", "label", "base", "length", "at"
    )


def _hits(docs: DataFrame) -> DataFrame:
    """A row per hit and one, without a template, per document."""

    def grams(words: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.size(words) - GRAM + 1),
            lambda i: _hashes([F.element_at(words, i + n) for n in range(GRAM)]),
        )
        head = F.array(F.lit(None).cast("struct<h:bigint,g:int>"))
        return F.struct(
            F.size(words).alias("n_words"),
            F.when(F.size(words) < GRAM, head).otherwise(F.concat(head, runs)).alias("grams"),
        )

    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))
    rows = (
        docs.select(
            "doc_id",
            F.xxhash64(text).alias("text_hash"),
            F.length(text).alias("text_length"),
            let(words, grams).alias("out"),
        )
        .select("doc_id", "text_hash", "text_length", "out.n_words", F.posexplode("out.grams"))
        .select("doc_id", "text_hash", "text_length", "n_words", "pos", "col.h", "col.g")
    )
    templates = F.broadcast(template_grams(docs.sparkSession))
    return (
        rows.join(templates, ["h", "g"], "left")
        .where("template is not null or pos = 0")
        # Place 0 is the document's own row, so the first run is at place 1.
        .withColumn("diagonal", F.col("pos") - 1 - F.col("at"))
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with what was found in it.

    ``doc_id``, ``n_words``, ``base_places`` (array<struct<start, label>> in order),
    ``spans`` (verified: array<struct<label, start, end, coverage>>) and ``coverage``,
    the largest share of a template that a band covers.
    """
    document = ("doc_id", "text_hash", "text_length", "n_words")
    of_template = (*document, "template", "label", "base", "length")
    diagonals = (
        _hits(docs)
        .groupBy(*of_template, "diagonal")
        .agg(F.collect_set("at").alias("votes"), F.count("*").alias("rows"))
        .withColumn(
            "covered",
            F.array_distinct(
                F.flatten(
                    F.transform("votes", lambda at: F.sequence(at, at + (GRAM - 1)))
                )
            ),
        )
    )
    in_order = Window.partitionBy(*of_template).orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(in_order)
    bands = (
        diagonals.withColumn("opens", F.when(step <= NEIGHBOURS, 0).otherwise(1))
        .withColumn("band", F.sum("opens").over(in_order))
        .groupBy(*of_template, "band")
        .agg(
            F.sum("rows").alias("rows"),
            F.min(F.col("diagonal") + F.array_min("covered")).alias("start"),
            F.max(F.col("diagonal") + F.array_max("covered") + 1).alias("end"),
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("together"),
            F.max(F.size("covered")).alias("alone"),
            F.collect_list(
                F.when(F.size("votes") == F.col("length") - (GRAM - 1), F.col("diagonal"))
            ).alias("full"),
        )
        .withColumn(
            "share",
            F.when(
                F.col("end") - F.col("start") <= F.col("length") * STRETCH + MORE_WORDS,
                F.col("together"),
            ).otherwise(F.col("alone"))
            / F.col("length"),
        )
    )
    places = F.transform(
        F.col("full"),
        lambda start: F.struct(start.cast("long").alias("start"), F.col("label").alias("label")),
    )
    span = F.struct("label", "start", "end", F.col("share").alias("coverage"))
    return (
        bands.groupBy(*document)
        .agg(
            F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("copies"),
            F.array_sort(F.flatten(F.collect_list(F.when(F.col("base"), places)))).alias(
                "base_places"
            ),
            F.array_sort(
                F.collect_list(F.when(F.col("share") >= MIN_COVERAGE, span))
            ).alias("spans"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("coverage"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id", F.col("n_words").cast("long"), "base_places", "spans", "coverage"
        )
    )
