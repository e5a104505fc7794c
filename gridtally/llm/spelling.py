"""Spelling variants: words one edit apart, found by walking a trie that is a table.

The trie's edges are rows: parent node, character, child node. A state holds a word, how
many of its characters are read, the node reached and the one edit made so far. Each
round joins all states with the edges on node and next character, so a round reads one
more character of every word that is still under way, and states that find no edge end.
A state that reads the end mark stands on another word of the vocabulary, one edit away.

What keeps the frontier small:

* Two tries, of the words and of the words spelt backwards. An edit in the second half of
  a word is walked in the first trie, one in the first half in the other. So an edit only
  happens below a node that has read at least half a word exactly, where few words are
  left; the top nodes, which all words share, never branch.
* A replacement goes to a grandchild: it joins on node and on the character behind the
  replaced one. Only the larger of two words' characters is put in, and only deletions
  are walked: the pairs are read in both directions afterwards.
* Below a node with a single word nothing branches: the state is compared with that word.

Rounds are bounded by ``DEPTH``. Two words that are both longer are compared by hashes of
all their forms with one character left out or blanked, made in linear time, and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import checkpointed, lower_ascii

#: Letters of a word: A to Z in both cases and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: Characters of a word that the trie reads; it also takes words of one more.
DEPTH = 48
#: Stands behind each word; no letter.
END = "$"
FORWARD, BACKWARD = 0, 1


# -- the vocabulary ----------------------------------------------------------------


def corpus_words(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_length: int = 5,
    min_count: int = 3,
    slip_every: int | None = None,
) -> DataFrame:
    """``word`` and ``n``: the distinct words of whole texts and how often they occur.

    Words are maximal runs of ``LETTERS`` with A-Z lower-cased. With ``slip_every`` some
    occurrences lose a letter, to measure the grouping on known slips: where that number
    divides the CRC-32 of ``id:word``, its remainder by the word's length is the place.
    Words with fewer than ``min_length`` code points or ``min_count`` occurrences are
    left out. NULL texts hold no words; a NULL id counts as an empty string; repeated
    rows count as often as they are there; other columns are not read.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col(text_column)), F.lit(f"[{LETTERS}]+"), F.lit(0))
    identity = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    words = docs.select(identity.alias("id"), F.explode(runs).alias("run"))
    # A slip makes a word shorter, so shorter runs cannot give a word that is kept.
    words = words.where(F.length("run") >= min_length)
    if slip_every is None:
        word = F.col("run")
    else:
        words = words.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        place = (F.col("h") % F.length("run")).cast("int")
        slipped = _without(F.col("run"), place)
        word = F.when(F.col("h") % slip_every == 0, slipped).otherwise(F.col("run"))
    counted = words.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def _without(word: Column, place: Column) -> Column:
    """The word without its code point at a 0-based place."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def _at(word: Column, place: Column) -> Column:
    return F.substring(word, place + 1, F.lit(1))


# -- the trie ----------------------------------------------------------------------


def _node(side: Column, prefix: Column) -> Column:
    return F.xxhash64(side, prefix)


def _spellings(words: DataFrame) -> DataFrame:
    """``side, spelling``: each word as it is and backwards."""
    return words.select(
        F.posexplode(F.array("word", F.reverse("word"))).alias("side", "spelling")
    )


def _trie(spellings: DataFrame) -> DataFrame:
    """A row for each node but the root: ``node, parent, grand, prev, last, n_words, leaf``.

    ``prev`` and ``last`` are the characters that lead to it from its grandparent and its
    parent; ``leaf`` is the end node of one of the ``n_words`` words below it. Nodes are
    named by hashes of their prefixes: should two prefixes share one, a state may go on
    that should have ended, and its word is then not found in the vocabulary.
    """
    marked = F.concat("spelling", F.lit(END))
    rows = spellings.select(
        "side", marked.alias("m"), F.explode(F.sequence(F.lit(1), F.length(marked))).alias("depth")
    )

    def prefix(shorter: int) -> Column:
        return F.substring(F.col("m"), F.lit(1), F.col("depth") - shorter)

    keys = {
        "node": _node(F.col("side"), prefix(0)),
        "parent": _node(F.col("side"), prefix(1)),
        "grand": F.when(F.col("depth") > 1, _node(F.col("side"), prefix(2))),
        "prev": F.when(F.col("depth") > 1, _at(F.col("m"), F.col("depth") - 2)),
        "last": _at(F.col("m"), F.col("depth") - 1),
    }
    named = rows.select(
        *(c.alias(name) for name, c in keys.items()),
        _node(F.col("side"), F.col("m")).alias("end_node"),
    )
    return named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_words"), F.max("end_node").alias("leaf")
    )


# -- the walk ----------------------------------------------------------------------


def _edited() -> Column:
    """The word a state is on the way to: its spelling with the edit made."""
    at = F.col("at")
    changed = F.concat(
        F.substring("spelling", F.lit(1), at),
        F.col("put"),
        F.substring(F.col("spelling"), at + 2, F.length("spelling")),
    )
    return F.coalesce(changed, _without(F.col("spelling"), at))




def _first_edits(spellings: DataFrame, trie: DataFrame) -> DataFrame:
    """The states behind an edit and one more character, for all edits in second halves."""
    size = F.length("spelling")
    half = F.floor(size / 2).cast("int")
    start = F.when(F.col("side") == FORWARD, half).otherwise(size - half)
    places = spellings.select(
        "side", "spelling", F.explode(F.sequence(start, size - 1)).alias("at")
    ).select(
        "*",
        _node(F.col("side"), F.substring(F.col("spelling"), F.lit(1), F.col("at"))).alias("here"),
        _at(F.col("spelling"), F.col("at")).alias("own"),
        _at(F.concat("spelling", F.lit(END)), F.col("at") + 1).alias("next"),
    )
    replaced = places.join(
        trie, (F.col("here") == F.col("grand")) & (F.col("next") == F.col("last"))
    ).where(F.col("prev") > F.col("own"))
    # Leaving out any of several equal letters in a row gives the same word.
    left_out = places.where("own <> next").join(
        trie, (F.col("here") == F.col("parent")) & (F.col("next") == F.col("last"))
    )
    read = (F.col("at") + 2).alias("read")
    columns = ["side", "spelling", "at"]
    rest = [read, "node", "n_words", "leaf"]
    return replaced.select(*columns, F.col("prev").alias("put"), *rest).unionByName(
        left_out.select(*columns, F.lit(None).cast("string").alias("put"), *rest)
    )


def _advanced(states: DataFrame, branching: DataFrame) -> DataFrame:
    """One more character read by every state that has an edge for it."""
    wanted = _at(F.concat("spelling", F.lit(END)), F.col("read"))
    here = states.select(
        "side", "spelling", "at", "put", "read", F.col("node").alias("here"), wanted.alias("next")
    )
    onward = here.join(
        branching, (F.col("here") == F.col("parent")) & (F.col("next") == F.col("last"))
    )
    return onward.select(
        "side", "spelling", "at", "put", (F.col("read") + 1).alias("read"), "node", "n_words", "leaf"
    )


def _arrived(states: DataFrame) -> DataFrame:
    """``a, b`` of the states below whose node there is only the word they are on the way to."""
    other = states.where("n_words = 1").select("side", "spelling", "leaf", _edited().alias("other"))
    same = other.where(
        F.col("leaf") == _node(F.col("side"), F.concat("other", F.lit(END)))
    )

    def forward(name: str) -> Column:
        return F.when(F.col("side") == FORWARD, F.col(name)).otherwise(F.reverse(name))

    return same.select(forward("spelling").alias("a"), forward("other").alias("b"))


def _walked_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: pairs one edit apart of words that the trie holds. Pairs may repeat."""
    spellings = _spellings(words.where(F.length("word") <= DEPTH + 1))
    trie = checkpointed(_trie(spellings))
    shared = trie.where("n_words > 1").select(F.col("node").alias("_shared"))
    branching = checkpointed(
        trie.join(shared, F.col("parent") == F.col("_shared"), "left_semi").select(
            "parent", "last", "node", "n_words", "leaf"
        )
    )
    states = checkpointed(_first_edits(spellings, trie))
    pairs = _arrived(states)
    while not (under_way := states.where("n_words > 1")).isEmpty():
        states = checkpointed(_advanced(under_way, branching))
        pairs = pairs.unionByName(_arrived(states))
    return pairs


# -- words longer than the trie ----------------------------------------------------

_MODULUS, _BASE = (1 << 61) - 1, 1_000_003


def _forms(word: str) -> Iterator[tuple[int, int]]:
    """Place and hash of the word (-1), and with each place left out and blanked.

    Left-out forms have place -1 as well: they are compared with whole words.
    """
    codes = [ord(c) for c in word]
    suffix = [0] * (len(codes) + 1)
    power = 1
    for i in range(len(codes) - 1, -1, -1):
        suffix[i] = (codes[i] * power + suffix[i + 1]) % _MODULUS
        power = power * _BASE % _MODULUS
    yield -1, suffix[0]
    inverse, prefix = pow(_BASE, -1, _MODULUS), 0
    for i, code in enumerate(codes):
        power = power * inverse % _MODULUS  # of the characters behind this one
        yield -1, (prefix * power + suffix[i + 1]) % _MODULUS
        yield i, (prefix * power * _BASE + suffix[i + 1]) % _MODULUS
        prefix = (prefix * _BASE + code) % _MODULUS


def _hashed_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, word in zip(batch["name"], batch["word"]):
            forms = pd.DataFrame(_forms(word), columns=["place", "hash"])
            forms["size"] = len(word)
            # Left out: one shorter than the word; the first row is the word itself.
            forms.loc[(forms["place"] == -1) & (forms.index > 0), "size"] -= 1
            yield forms.assign(name=name, whole=forms.index == 0)


def _hashed_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: pairs one edit apart of words longer than the trie reads."""
    named = words.where(F.length("word") > DEPTH).select("word", F.sha2("word", 256).alias("name"))
    forms = checkpointed(
        named.mapInPandas(_hashed_forms, "name string, place long, hash long, size long, whole boolean")
    )
    key = ["size", "place", "hash"]
    whole = forms.where("whole or place >= 0").select(*key, F.col("name").alias("x"))
    others = forms.where("not whole").select(*key, F.col("name").alias("y"))
    met = whole.join(others, key).where("x <> y").select("x", "y").distinct()
    left = named.select(F.col("name").alias("x"), F.col("word").alias("a"))
    right = named.select(F.col("name").alias("y"), F.col("word").alias("b"))
    both = met.join(left, "x").join(right, "y").select("a", "b")
    return both.where(F.levenshtein("a", "b", 1) == 1)


# -- variants ----------------------------------------------------------------------


def near_words(words: DataFrame) -> DataFrame:
    """``word, near``: all ordered pairs of words exactly one edit apart, each once.

    An edit inserts, deletes or replaces one code point. ``words`` has distinct words,
    none of them NULL, without the end mark ``$``.
    """
    pairs = _walked_pairs(words)
    if not words.where(F.length("word") > DEPTH).isEmpty():
        pairs = pairs.unionByName(_hashed_pairs(words))
    a, b = F.col("a"), F.col("b")
    ways = [F.struct(x.alias("word"), y.alias("near")) for x, y in ((a, b), (b, a))]
    return pairs.select(F.inline(F.array(*ways))).distinct()


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``word, n``.

    ``form`` is the near word (one edit away) with the largest ``n``, ties going to the
    smallest in code-point order, if it occurs at least ``ratio`` times (2 or more) as
    often as the word; else NULL, and so is ``form_n``. ``root`` is where following forms
    ends, the word itself if it has none. Words must be distinct; an empty table gives no
    rows.
    """
    if ratio < 2:
        raise ValueError("forms could go in circles")
    words = checkpointed(words.select("word", "n"))
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # The join also drops what a shared node name let through.
    near = near_words(words).join(known, "near")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("near")))
    summed = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    most = -F.col("best.minus_n")
    follows = most >= F.col("n") * ratio
    formed = checkpointed(
        words.join(summed, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(follows, F.col("best.near")).alias("form"),
            F.when(follows, most).alias("form_n"),
        )
    )
    roots = _roots(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """``word, root``: where the links end. Each round doubles the links followed."""
    now = checkpointed(links)
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = checkpointed(now.join(onward, "root", "left").select("word", "root", "further"))
        if jumped.where("further is not null").isEmpty():
            return now
        now = jumped.select("word", F.coalesce("further", "root").alias("root"))
