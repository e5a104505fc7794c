"""Missing-value rules, each on a hand-made frame."""

import pytest
from pyspark.sql import functions as F

from gridtally.functions import exact, missing
from gridtally.operators import joins


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df, *columns):
    return tuple(df.agg(*columns).first())


def test_distinct_counts_null_as_a_value(spark):
    rows = [("a", 1), ("a", None), (None, None), (None, 1), ("a", 1)]
    df = frame(spark, rows, "a string, b int")
    counts = one(
        df,
        missing.distinct_with_null(F.col("a")),
        missing.distinct_with_null(F.col("a"), F.col("b")),
    )
    assert counts == (2, 4)


def test_nan_is_missing(spark):
    df = frame(spark, [(float("nan"),), (None,), (-1.0,), (0.0,), (3.0,)], "x double")
    x = exact.nan_to_null(F.col("x"))
    rows = df.select(x, missing.sign_label(x)).collect()
    assert [tuple(r) for r in rows] == [
        (None, None),
        (None, None),
        (-1.0, "Inactive"),
        (0.0, "Inactive"),
        (3.0, "Active"),
    ]


def test_nulls_sort_last(spark):
    df = frame(spark, [(None, 1), ("b", 2), ("a", None), ("a", 3)], "k string, v int")
    ordered = df.orderBy(*missing.nulls_last("k", "v"))
    assert [tuple(r) for r in ordered.collect()] == [("a", 3), ("a", None), ("b", 2), (None, 1)]


# -- joins -------------------------------------------------------------------------


@pytest.fixture()
def sides(spark):
    left = frame(spark, [("a", 1), ("b", 2), (None, 3), ("a", 4)], "k string, x int")
    right = frame(spark, [("a", 10), ("a", 11), (None, 12), ("z", 13)], "k string, y int")
    return left, right


EXPECTED = [
    ("a", 1, 10),
    ("a", 1, 11),
    ("a", 4, 10),
    ("a", 4, 11),
    ("b", 2, None),
    (None, 3, 12),
]


def rows_of(df, *columns):
    rows = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(rows, key=lambda row: [(v is None, v) for v in row])


@pytest.mark.parametrize("join", [joins.left_join, joins.left_join_many])
def test_left_joins_match_null_and_fan_out(sides, join):
    left, right = sides
    out = join(left, right, ["k"])
    assert set(out.columns) == {"k", "x", "y"}
    assert rows_of(out, "k", "x", "y") == EXPECTED


def test_two_key_join(spark):
    left = frame(spark, [("a", None, 1), ("a", "e", 2)], "k string, e string, x int")
    right = frame(spark, [("a", None, 5), ("a", "f", 6)], "k string, e string, y int")
    out = joins.left_join(left, right, ["k", "e"])
    assert rows_of(out, "k", "e", "x", "y") == [("a", "e", 2, None), ("a", None, 1, 5)]


def test_membership_is_never_null(sides):
    left, right = sides
    flagged = joins.flag_members(left, right, "k", "known")
    assert rows_of(flagged, "k", "x", "known") == [
        ("a", 1, True),
        ("a", 4, True),
        ("b", 2, False),
        (None, 3, True),
    ]
    without_null = joins.flag_members(left, right.filter("k is not null"), "k", "known")
    assert rows_of(without_null, "x", "known")[2] == (3, False)


def test_semi_join_keeps_rows_once(sides):
    left, right = sides
    assert rows_of(joins.semi_join(left, right, ["k"]), "x") == [(1,), (3,), (4,)]
