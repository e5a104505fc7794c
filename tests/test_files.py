"""CSV tables, JSON documents, sinks and whole jobs on temporary folders."""

import csv
import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from gridtally import jobs
from gridtally.functions.numbers import integer_from_text, number_from_text
from gridtally.plans import model_compare
from gridtally.sources import documents, sinks
from gridtally.sources.tables import CellReport, read_csv

EXPORT = jobs.EXPORT_COLUMNS


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def written(folder):
    """Header and sorted rows of a CSV folder, as raw text cells."""
    rows, header = [], None
    for path in sorted(glob.glob(f"{folder}/part-*.csv")):
        with open(path, newline="") as handle:
            head, *body = list(csv.reader(handle))
            header, rows = head, rows + body
    return header, sorted(rows)


# -- CSV ---------------------------------------------------------------------------


def test_cells(spark, tmp_path):
    path = put(
        tmp_path,
        "export.csv",
        "extra,item_id,Non-responsive,timestamp,metered_savings\n"
        "1, 7_AMI ,TRUE,2024-07-12T19:00:00Z,1.5\n"
        "1,NA,F,2024-07-12 19:00:00,NA\n"
        '1,"8_AMI, old",yes,soon,1.5.2\n'
        "1,,T,,\n"
        "1,9,false,2024-07-12 13:00:00-06:00, NaN \n"
        "1,short\n",
    )
    at = dt.datetime(2024, 7, 12, 19)
    assert [tuple(r) for r in read_csv(spark, path, EXPORT).collect()] == [
        ("7_AMI", at, 1.5, True),
        (None, at, None, False),
        ("8_AMI, old", None, None, None),
        (None, None, None, True),
        ("9", at, None, False),
        ("short", None, None, None),
    ]


def test_lost_cells_are_counted_in_the_pass(spark, tmp_path):
    path = put(
        tmp_path,
        "e.csv",
        "item_id,timestamp,metered_savings,Non-responsive\n"
        "1,2024-07-12T19:00:00Z,1.5,TRUE\n2,soon,NA,maybe\n,,1.5.2,\n3,2024-07-12T19:00:00Z,1e999,F\n",
    )
    report = CellReport()
    rows = read_csv(spark, path, EXPORT, report=report, table="e")
    assert rows.columns == list(EXPORT)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    # A filter above the counts does not change them.
    assert rows.filter("item_id = '1'").count() == 1
    assert {tuple(r)[1:] for r in report.table(spark).collect()} == {
        ("item_id", 3, 0), ("timestamp", 3, 1), ("metered_savings", 3, 2), ("Non-responsive", 3, 1),
    }


def test_cells_of_a_skipped_pass_are_counted_for_the_report(spark, tmp_path):
    reads = put(tmp_path, "reads.csv", "k,v\na,1\nb,x\n")
    report = CellReport()
    rows = read_csv(spark, reads, {"k": "string", "v": "double"}, report=report, table="reads")
    nothing = spark.createDataFrame([], "k string")
    assert rows.join(nothing, "k", "left_semi").collect() == []
    assert {tuple(r) for r in report.table(spark).collect()} == {("reads", "k", 2, 0), ("reads", "v", 2, 1)}


def test_blanks_may_stay(spark, tmp_path):
    path = put(tmp_path, "f.csv", 'item_id,metered_savings\n,1\n"",\nNA,2\n a ,NA\n')
    rows = read_csv(spark, path, jobs.FRAME_COLUMNS, blank_is_null=False).collect()
    assert [tuple(r) for r in rows] == [("", 1.0), ("", None), (None, 2.0), (" a ", None)]


def test_header_names_are_verbatim(spark, tmp_path):
    path = put(
        tmp_path,
        "reads.csv",
        "Account #,kWh,Hour,Day,Month,Year,Weather Station ID\nab1,1.05,0,1,7,2023,W1\n",
    )
    reads = jobs.read_hourly_reads(spark, path)
    assert reads.columns == ["account_id", "year", "month", "day", "hour", "kwh"]
    assert tuple(reads.first()) == ("ab1", 2023, 7, 1, 0, 1.05)


def test_integers_written_as_doubles(spark, tmp_path):
    path = put(tmp_path, "f.csv", "n\n7.0\n8\nx\n99999999999\n")
    rows = read_csv(spark, path, {"n": "int"}).collect()
    assert [r.n for r in rows] == [7, 8, None, None]


def test_absent_column_and_unknown_type_raise(spark, tmp_path):
    path = put(tmp_path, "f.csv", "a\n1\n")
    with pytest.raises(ValueError, match="not in the header"):
        read_csv(spark, path, {"b": "string"})
    with pytest.raises(ValueError, match="unknown column type"):
        read_csv(spark, path, {"a": "money"})


def test_line_breaks_in_quotes(spark, tmp_path):
    path = put(tmp_path, "f.csv", 'a,b\n"x\ny",1\nz,2\n')
    rows = read_csv(spark, path, {"a": "string", "b": "int"}, multiline=True).collect()
    assert [tuple(r) for r in rows] == [("x\ny", 1), ("z", 2)]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 1.5, True), (None, None, None), ('say "hi"', -0.25, False)]
    df = spark.createDataFrame(rows, "k string, x double, flag boolean")
    out = str(tmp_path / "out")
    sinks.write_csv(df, out, one_file=True)
    assert written(out)[0] == ["k", "x", "flag"]
    assert ["NA", "NA", "NA"] in written(out)[1]
    back = read_csv(spark, out, {"k": "string", "x": "double", "flag": "boolean"})
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    sinks.write_csv(df.limit(1), out, quote_all=True)
    (path,) = [p for p in glob.glob(f"{out}/part-*.csv") if "a,b" in open(p).read()]
    assert open(path).read().splitlines()[0] == '"k","x","flag"'


# -- documents ---------------------------------------------------------------------

DOCUMENTS = {
    "metered_savings_flat.txt": (
        '{"metered_savings":{"2024-07-12 19:00:00":1.5,"2024-07-12 20:00:00":null}}'
    ),
    "metered_savings_wrapped.txt": (
        '{"data":{"metered_savings":{"2024-07-12T19:00:00Z":2}},'
        '"metered_savings":{"2024-07-12T20:00:00Z":9}}'
    ),
    "metered_savings_bare.txt": '{"data":{"x":1},"metered_savings":{"2024-07-12T20:00:00Z":9}}',
    "metered_savings_nulldata.txt": (
        '{"data":null,"metered_savings":{"2024-07-12T20:00:00Z":4}}'
    ),
    "metered_savings_bad.txt": "{bad",
    "metered_savings_empty.txt": "\n",
    "metered_savings_array.txt": "[1]",
    "metered_savings_odd.txt": (
        '{"metered_savings":{"2024-07-12T19:00:00Z":"x","2024-07-12T20:00:00Z":3,'
        '"2024-07-12T21:00:00Z":"2.5","2024-07-12T22:00:00Z":[1,2],"later":1}}'
    ),
    "metered_savings_twice.txt": (
        '{"metered_savings":{"2024-07-12T19:00:00Z":1.0,"2024-07-12T19:00:00Z":2.0}}'
    ),
    "metered_savings_none.txt": '{"metered_savings":{}}',
    "sub dir/deep+er/metered_savings_nested.txt": (
        '{\n  "metered_savings": {\n    "2024-07-12T19:00:00Z": 0.1\n  }\n}\n'
    ),
    "hourly_model_full_output_flat.txt": '{"site":"a","r2":0.5,"hours":[1,2]}',
    "hourly_model_full_output_bad.txt": "{bad",
    "metered_savings_note.md": "not a document",
}


@pytest.fixture()
def folder(tmp_path):
    for name, text in DOCUMENTS.items():
        put(tmp_path / "outputs", name, text)
    return str(tmp_path / "outputs")


def test_family_and_discovery(spark, folder):
    found = documents.read_savings_documents(spark, folder)
    names = {r.file_name for r in found.collect()}
    expected = {
        name.split("/")[-1]
        for name in DOCUMENTS
        if "metered_savings_" in name and name.endswith(".txt")
    }
    assert names == expected
    nested = found.filter("file_name = 'metered_savings_nested.txt'").first()
    assert nested.file_path.endswith("/sub dir/deep+er/metered_savings_nested.txt")


def test_empty_and_vanished_files_are_rejected(spark, tmp_path):
    put(tmp_path / "docs", "metered_savings_a.txt", "{}")
    put(tmp_path / "docs", "sub dir/metered_savings_b+c.txt", "")
    put(tmp_path / "docs", "metered_savings_gone.txt", "{}")
    folder = str(tmp_path / "docs")
    listed = documents.list_documents(spark, folder)
    texts = documents.read_savings_documents(spark, folder)
    (tmp_path / "docs" / "metered_savings_gone.txt").unlink()
    parsed = documents.with_unread(documents.parse_savings(texts), listed)
    assert {(r.file_name, r.status) for r in parsed.collect()} == {
        ("metered_savings_a.txt", "loaded"),
        ("metered_savings_b+c.txt", "rejected"),
        ("metered_savings_gone.txt", "rejected"),
    }


def test_no_file_name_passes_the_driver(spark, tmp_path, monkeypatch):
    for i in range(40):
        put(tmp_path / "docs", f"run {i % 7}/metered_savings_{i}%20é.txt", "{}" if i % 3 else "")

    def refused(*_, **__):
        raise AssertionError("a list of files on the driver")

    monkeypatch.setattr(type(spark.range(0)), "inputFiles", refused)
    monkeypatch.setattr(type(spark.range(0)), "collect", refused)
    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    folder = str(tmp_path / "docs")
    listed = documents.list_documents(spark, folder)
    parsed = documents.parse_savings(documents.read_savings_documents(spark, folder))
    whole = documents.with_unread(parsed, listed)
    monkeypatch.undo()
    assert whole.groupBy("status", "reason").count().orderBy("status").collect() == [
        ("loaded", None, 26), ("rejected", "not read", 14),
    ]
    assert {r.file_name for r in whole.collect()} == {f"metered_savings_{i}%20é.txt" for i in range(40)}


def test_family_matches_the_whole_path(spark, tmp_path):
    put(tmp_path / "docs", "metered_savings_run/other.txt", "{}")
    found = documents.read_savings_documents(spark, str(tmp_path / "docs"))
    assert [r.file_name for r in found.collect()] == ["other.txt"]


def test_nothing_found_raises(spark, tmp_path):
    put(tmp_path / "docs", "readme.md", "x")
    with pytest.raises(ValueError, match="no .txt files"):
        documents.read_savings_documents(spark, str(tmp_path / "docs"))


def test_flatten_files(spark, folder):
    parsed = documents.parse_savings(documents.read_savings_documents(spark, folder))
    hourly = model_compare.flatten(parsed)
    rows = hourly.select("id", F.hour("time").alias("h"), "savings", "unreadable").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [
            ("flat", 13, 1.5, False),
            ("flat", 14, 0.0, False),
            ("wrapped", 13, 2.0, False),
            ("nulldata", 14, 4.0, False),
            ("odd", 13, None, True),
            ("odd", 14, 3.0, False),
            ("odd", 15, 2.5, False),
            ("odd", 16, None, True),
            ("odd", None, 1.0, False),
            ("twice", 13, 1.0, False),
            ("twice", 13, 2.0, False),
            ("nested", 13, 0.1, False),
        ],
        key=str,
    )
    totals = {r[0]: r[1] for r in model_compare.site_savings(hourly).collect()}
    assert totals == {
        "flat": 1.5,
        "wrapped": 2.0,
        "nulldata": 4.0,
        "odd": None,
        "twice": 3.0,
        "nested": 0.1,
    }
    window = dt.datetime(2024, 7, 12, 14), dt.datetime(2024, 7, 12, 16)
    inside = model_compare.in_event_window(hourly, *window)
    assert {(r[0], r[1]) for r in inside.select("id", F.hour("time")).collect()} == {
        ("flat", 14),
        ("nulldata", 14),
        ("odd", 14),
        ("odd", 15),
        ("odd", 16),
    }


def test_envelope_is_optional(spark, folder):
    texts = documents.read_savings_documents(spark, folder)
    as_is = model_compare.flatten(documents.parse_savings(texts, unwrap=False))
    rows = as_is.filter("id in ('wrapped', 'bare')").select("id", "savings").collect()
    assert sorted(map(tuple, rows)) == [("bare", 9.0), ("wrapped", 9.0)]


def test_rejects_and_report(spark, folder):
    parsed = documents.parse_savings(documents.read_savings_documents(spark, folder))
    assert {r.file_name: r.text for r in documents.rejects(parsed).collect()} == {
        "metered_savings_bad.txt": "{bad",
        "metered_savings_empty.txt": "\n",
        "metered_savings_array.txt": "[1]",
    }
    report = {r.status: tuple(r)[1:] for r in documents.load_report(parsed).collect()}
    assert report == {"loaded": (8, 12, 2, 1), "rejected": (3, 0, 0, 0)}
    reasons = {tuple(r) for r in documents.reject_reasons(parsed).collect()}
    assert reasons == {("truncated", 1), ("blank", 1), ("no object", 1)}


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (None, "blank"), ("", "blank"), (" \n\t", "blank"), ("{", "truncated"), ('{"metered_savings":{"a', "truncated"),
        ('{"metered_savings":{"a":1}', "truncated"), ('{"a":"}}"', "truncated"), ('["x", {"y":1}', "truncated"),
        ('{"a":1}}', "trailing text"), ('{"a":1} {"a":2}', "trailing text"), ("[1],[2]", "trailing text"),
        ("[]", "no object"), ("3.5", "no object"), ('"text"', "no object"), ("null", "no object"),
        ("savings", "malformed"), ('{"a" 1}', "malformed"), ("{a}", "malformed"),
        ('{"metered_savings":[1]}', "wrong field type"), ('{"metered_savings":5}', "wrong field type"),
        ('{"data":[{"metered_savings":{}}]}', "wrong field type"), ('{"data":{"metered_savings":"x"}}', "wrong field type"),
        ('{"data":{"x":1},"metered_savings":7}', None), ('{"data":null,"metered_savings":null}', None),
        ("{}", None), ('{"metered_savings":{}}', None), ('{"metered_savings":{"a":1}}', None),
    ],
)
def test_reasons(spark, text, reason):
    df = spark.createDataFrame([("f.txt", text)], "file_name string, text string")
    row = documents.parse_savings(df).first()
    assert (row.reason, row.status) == (reason, "loaded" if reason is None else "rejected")


def test_envelope_that_is_not_unwrapped_may_be_anything(spark):
    df = spark.createDataFrame([("f.txt", '{"data":5,"metered_savings":{"a":1}}')], "file_name string, text string")
    assert documents.parse_savings(df).first().reason == "wrong field type"
    assert documents.parse_savings(df, unwrap=False).first().reason is None


def test_documents_of_unknown_shape(spark, folder):
    hourly = documents.of_family(
        documents.read_text_documents(spark, folder), documents.HOURLY_FAMILY
    )
    parsed = documents.parse_any(hourly)
    assert parsed.filter("document is null").count() == 1
    profile = {r.field: (r.n_documents, r.type) for r in documents.profile(parsed).collect()}
    assert profile["site"] == (1, "STRING")
    assert profile["hours"] == (1, "ARRAY<BIGINT>")
    assert set(profile) == {"site", "r2", "hours"}


def rows_of(spark, texts, kind=None):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    table = documents.typed_rows(documents.parse_any(df), kind)
    return table.columns, sorted((tuple(r) for r in table.collect()), key=str)


def test_typed_rows(spark):
    columns, rows = rows_of(
        spark,
        [
            '{"site":"a","r2":0.5,"hours":[1,2,3],"load":[1.5,null],"deep":{"x":{"y":7}},"odd`name":1}',
            '{"site":"b","r2":1,"mixed":"text","deep_x_y":"taken"}',
            '{"mixed":2.5,"parts":[{"p":1}],"hours":[]}',
            "[1]", "{bad", '{"site":"c"} {}', None, "{}",
        ],
    )
    assert columns == [
        "n", "row", "deep_x_y", "deep_x_y_2", "hours", "load", "mixed", "odd`name", "parts", "r2", "site",
    ]
    assert rows == [
        (0, 0, 7, None, 1, 1.5, None, 1, None, 0.5, "a"),
        (0, 1, 7, None, 2, None, None, 1, None, 0.5, "a"),
        (0, 2, 7, None, 3, None, None, 1, None, 0.5, "a"),
        (1, 0, None, "taken", None, None, '"text"', None, None, 1.0, "b"),
        (2, 0, None, None, None, None, "2.5", None, '[{"p":1}]', None, None),
        (7, 0, None, None, None, None, None, None, None, None, None),
    ]


def test_typed_rows_of_nothing(spark):
    assert rows_of(spark, ["[1]", "x"]) == (["n", "row"], [])
    assert rows_of(spark, [])[1] == []


def test_typed_rows_of_a_known_type(spark):
    from pyspark.sql.types import LongType, StructType

    columns, rows = rows_of(spark, ['{"a":1,"b":2}', '{"a":"x"}'], StructType().add("a", LongType()))
    assert columns == ["n", "row", "a"] and rows == [(0, 0, 1), (1, 0, None)]


# -- comparison ----------------------------------------------------------------------


def test_model_vs_vendor(spark):
    modelled = spark.createDataFrame(
        [("1", 1.0), ("2", 2.0), ("3", None), (None, 4.0)], "id string, model_metered_savings double"
    )
    vendor = spark.createDataFrame(
        [("1_AMI", 1.25), ("1_AMI", 3.0), ("3_AMI", 1.0), ("9_AMI", 1.0), (None, 5.0)],
        "item_id string, metered_savings double",
    )
    compared = model_compare.model_vs_vendor(modelled, vendor)
    assert sorted(map(tuple, compared.collect()), key=str) == sorted(
        [
            ("1_AMI", "1", 1.25, 1.0, 0.25),
            ("1_AMI", "1", 3.0, 1.0, 2.0),
            (None, "2", None, 2.0, None),
            ("3_AMI", "3", 1.0, None, None),
            (None, None, 5.0, 4.0, 1.0),
        ],
        key=str,
    )
    mean = model_compare.mean_difference(compared).first()
    assert tuple(mean) == (None, 3.25 / 3, 5, 3)


def test_histogram_bins_are_centred_and_closed_right(spark):
    gaps = [0.0, 0.05, 0.0500001, 0.15, 0.16, 1.0, None]
    df = spark.createDataFrame([(g,) for g in gaps], "absolute_savings_difference double")
    bins = {r.bin: r.n_sites for r in model_compare.difference_histogram(df).collect()}
    assert bins == {0: 2, 1: 2, 2: 1, 10: 1}


def test_linear_fit(spark):
    rows = [(x / 4, 2 * x / 4 + 1) for x in range(9)] + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame(rows, "vendor_estimation double, model_estimation double")
    assert tuple(model_compare.linear_fit(df).first()) == (2.0, 1.0, 1.0, 9)


# -- jobs --------------------------------------------------------------------------


def test_event_savings_job(spark, tmp_path):
    head = "item_id,timestamp,metered_savings,Non-responsive\n"
    first = put(
        tmp_path,
        "e1.csv",
        head + "1_AMI,2024-07-12T19:00:00Z,2000,FALSE\n2_AMI,2024-07-12T19:00:00Z,-1000,FALSE\n",
    )
    second = put(tmp_path, "e2.csv", head + "1_AMI,2024-08-12T20:00:00Z,500,TRUE\n")
    customers = put(
        tmp_path,
        "customers.csv",
        "customer_id,event1_in_info,event2_in_info,event3_in_info,event4_in_info\n"
        "1,Yes,Yes,No,No\n2,Yes,NA,No,No\n",
    )
    dropped = put(tmp_path, "partly.csv", "meterId\n3_AMI\n")
    out = str(tmp_path / "out")
    tables = jobs.event_savings_report(
        spark,
        jobs.EventFiles({"Event 1": first, "Event 2": second}, customers, [dropped], {"Event 1": first}),
        out,
    )
    assert written(f"{out}/summary") == (
        ["event", "interval", "mw_reduction_active", "mw_reduction_inactive"],
        [
            ["Event 1", "13:00:00-14:00:00", "2.0", "-1.0"],
            ["Event 2", "14:00:00-15:00:00", "0.0", "0.0"],
        ],
    )
    reading = {n for n, t in tables.items() if t.inputFiles() and _reads_file(t, "savings_clean")}
    assert reading == {"savings_clean", "event_totals", "updated_savings"}
    assert written(f"{out}/updated_savings")[1] == [["1", "TRUE", "FALSE", "FALSE", "2000.0"]]
    assert written(f"{out}/nonresponsive")[1] == [["Event 1", "13:00:00-14:00:00", "1", "1"]]
    assert written(f"{out}/all_filters")[0] == ["event", "interval"]
    assert tables["initial_totals"].first().total_kwh == 1000.0
    assert tables["savings_clean"].count() == 3
    cells = written(f"{out}/cell_report")[1]
    assert ["export Event 2", "timestamp", "1", "0"] in cells and ["customers", "event2_in_info", "1", "0"] in cells
    assert {row[0] for row in cells} == {
        "export Event 1", "export Event 2", "initial export Event 1", "customers", "meter list 1",
    }


def test_meter_read_job(spark, tmp_path):
    reads = put(
        tmp_path,
        "reads.csv",
        "Account #,kWh,Hour,Day,Month,Year,Weather Station ID\n"
        "a,1.25,6,1,7,2023,W\na,1.0,6,1,7,2023,W\na,4,7,2,7,2023,W\nb,NA,6,1,7,2023,W\nz,1,6,1,7,2023,W\n",
    )
    sites = put(tmp_path, "sites.csv", "model_id\na\nb\nc\n")
    out = str(tmp_path / "out")
    extract = (["a"], dt.date(2023, 7, 1))
    tables = jobs.meter_read_report(spark, reads, sites, out, extract=extract)
    # The reads are read once; every table comes from what was written then.
    assert not any(_reads_file(table, "reads.csv") for table in tables.values())
    assert written(f"{out}/extract")[1] == [["a", "2023", "7", "1", "0", "2", "2.25"]]
    assert written(f"{out}/same_month_totals")[1] == []
    assert written(f"{out}/summary_month") == (
        ["id", "year", "month", "n_observations", "total_kwh"],
        [["a", "2023", "7", "3", "6.25"], ["b", "2023", "7", "1", "NA"]],
    )
    assert written(f"{out}/summary_hour")[1] == [
        ["a", "2023", "7", "1", "0", "2", "2.25"],
        ["a", "2023", "7", "2", "1", "1", "4.0"],
        ["b", "2023", "7", "1", "0", "1", "NA"],
    ]
    assert written(f"{out}/site_coverage")[1] == [["FALSE", "1"], ["TRUE", "2"]]
    assert written(f"{out}/duplicate_reads")[1] == [["a", "2023", "7", "1", "6", "2"]]
    cells = written(f"{out}/cell_report")[1]
    assert ["reads", "kWh", "4", "0"] in cells and ["sites", "model_id", "3", "0"] in cells


def _reads_file(table, name):
    return any(name in file for file in table.inputFiles())


def test_model_job(spark, tmp_path, folder):
    frame = put(tmp_path, "frame.csv", "item_id,metered_savings\nflat_AMI,1\nwrapped_AMI,4\n")
    out = str(tmp_path / "out")
    tables = jobs.model_report(spark, folder, frame, out)
    # Documents are parsed once and the frame is read once.
    assert not any(_reads_file(table, ".txt") for table in tables.values())
    assert not any(_reads_file(table, "frame.csv") for table in tables.values())
    header, rows = written(f"{out}/savings_processed")
    assert header == [
        "sample_id",
        "model_id",
        "vendor_estimation",
        "model_estimation",
        "absolute_savings_difference",
    ]
    assert ["flat_AMI", "flat", "1.0", "1.5", "0.5"] in rows
    assert ["NA", "nested", "NA", "0.1", "NA"] in rows
    assert ["NA", "twice", "NA", "3.0", "NA"] in rows  # both entries of one time
    assert written(f"{out}/mean_difference")[1] == [["NA", "1.25", "6", "2"]]
    assert len(written(f"{out}/rejects")[1]) == 3
    assert len(written(f"{out}/site_ids")[1]) == 6


def test_sample_jobs(spark, tmp_path):
    lines = "".join(f"{i}_AMI,{i - 40}.5\n" for i in range(400))
    frame = put(tmp_path, "frame.csv", "item_id,metered_savings\n" + lines + "x,many\n")
    out = str(tmp_path / "stratified")
    jobs.stratified_sample_report(spark, frame, out, n_negative=10, n_per_quartile=20)
    assert ["frame", "metered_savings", "401", "1"] in written(f"{out}/cell_report")[1]
    header, rows = written(f"{out}/sample")
    assert header == ["item_id"] and len(rows) == 90
    assert ["negatives", "NEG", "10.0"] in written(f"{out}/sample_check")[1]
    out = str(tmp_path / "simple")
    jobs.simple_sample_report(spark, frame, out, n=25)
    assert len(written(f"{out}/sample")[1]) == 25


def test_generated_json_is_valid(spark, sf_small):
    from gridtally import inputs

    for row in inputs.model_documents(spark, sf_small).limit(20).collect():
        if row.text != "{bad":
            json.loads(row.text)


@pytest.mark.parametrize(
    ("text", "status"),
    [
        ('{"metered_savings":{"a":1}}', "loaded"),
        (' {"metered_savings":{"a":1}}\n', "loaded"),
        ('{"metered_savings":{"a":1}} junk', "rejected"),
        ('{"metered_savings":{"a":1}}{"metered_savings":{"a":5}}', "rejected"),
        ('{"metered_savings":{"a":1}},{"metered_savings":{"a":5}}', "rejected"),
        ('{"metered_savings":{"a":1}', "rejected"),
        ("[1]", "rejected"),
        ("  ", "rejected"),
        (None, "rejected"),
    ],
)
def test_only_one_whole_object_loads(spark, text, status):
    df = spark.createDataFrame([("f.txt", text)], "file_name string, text string")
    assert documents.parse_savings(df).first().status == status


def test_values_that_are_no_numbers(spark):
    good = {"1": 1.0, "-2.5": -2.5, "1e3": 1000.0, "+.5": 0.5, "3.": 3.0}
    bad = ["NaN", "Infinity", "1e999", "3d", "4f", "text", "0x1", "1_000", ""]
    df = spark.createDataFrame([(v,) for v in [*good, *bad]], "v string")
    out = {r.v: r.n for r in df.select("v", number_from_text(F.col("v")).alias("n")).collect()}
    assert out == {**good, **dict.fromkeys(bad)}
    whole = {r.v: r.n for r in df.select("v", integer_from_text(F.col("v")).alias("n")).collect()}
    assert whole["1"] == 1 and whole["1e3"] == 1000 and whole["-2.5"] is None


def test_one_bad_value_does_not_stop_the_others(spark):
    texts = ['{"metered_savings":{"2024-01-01 00:00:00":"NaN"}}', '{"metered_savings":{"2024-01-01 00:00:00":2}}']
    df = spark.createDataFrame(
        [(f"metered_savings_{i}.txt", t) for i, t in enumerate(texts)], "file_name string, text string"
    )
    hourly = model_compare.flatten(documents.parse_savings(df))
    out = {r.id: r.model_metered_savings for r in model_compare.site_savings(hourly).collect()}
    assert out == {"0": None, "1": 2.0}

