"""Meter reads on hand-made frames."""

import datetime as dt

import pytest

from gridtally.plans import meter_reads as mr

READS = "account_id string, year double, month double, day double, hour double, kwh double"


def rows_of(df, *columns):
    rows = [tuple(r) for r in df.select(*columns or df.columns).collect()]
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


def reads(spark, rows):
    typed = [(a, *map(float, parts), kwh) for a, *parts, kwh in rows]
    return spark.createDataFrame(typed, READS)


def sites(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "model_id string")


@pytest.fixture()
def autumn(spark):
    """Reads around the end of daylight saving, 3 November 2024."""
    return reads(
        spark,
        [
            ("a", 2024, 11, 3, 7, 1.0),  # 01:00 MDT
            ("a", 2024, 11, 3, 8, 2.0),  # 01:00 MST, the same wall-clock hour
            ("a", 2024, 11, 3, 9, 4.0),
            ("a", 2024, 11, 3, 5, 8.0),  # still 2 November in Denver
            ("b", 2024, 11, 3, 9, None),
            ("b", 2024, 11, 3, 10, 1.0),
            ("b", 2023, 2, 30, 1, 3.0),  # no such day
            ("x", 2024, 11, 3, 9, 100.0),  # not a listed site
        ],
    )


@pytest.fixture()
def local(spark, autumn):
    return mr.local_reads(mr.reads_of_sites(autumn, sites(spark, "a", "b", "b", "c")))


def test_local_parts(local):
    assert rows_of(local) == [
        ("a", 2024, 11, 2, 23, 8.0),
        ("a", 2024, 11, 3, 1, 1.0),
        ("a", 2024, 11, 3, 1, 2.0),
        ("a", 2024, 11, 3, 2, 4.0),
        ("b", 2024, 11, 3, 2, None),
        ("b", 2024, 11, 3, 3, 1.0),
        ("b", None, None, None, None, 3.0),
    ]


def test_totals_merge_the_repeated_hour(local):
    hours = rows_of(mr.read_totals(local, "hour"))
    assert ("a", 2024, 11, 3, 1, 2, 3.0) in hours
    assert ("b", 2024, 11, 3, 2, 1, None) in hours
    assert rows_of(mr.read_totals(local, "day")) == [
        ("a", 2024, 11, 2, 1, 8.0),
        ("a", 2024, 11, 3, 3, 7.0),
        ("b", 2024, 11, 3, 2, None),
        ("b", None, None, None, 1, 3.0),
    ]


@pytest.mark.parametrize("grain", ["month", "day"])
def test_totals_roll_up(local, grain):
    direct = mr.read_totals(local, grain)
    rolled = mr.coarser_totals(mr.read_totals(local, "hour"), grain)
    assert rows_of(direct) == rows_of(rolled)


def test_time_order(local):
    ordered = mr.in_time_order(mr.read_totals(local, "month"), "month").collect()
    assert [(r.year, r.month, r.id) for r in ordered] == [
        (2024, 11, "a"),
        (2024, 11, "b"),
        (None, None, "b"),
    ]


def test_distinct_readings(spark):
    rows = reads(
        spark,
        [
            ("a", 2024, 7, 1, 6, 1.5),
            ("b", 2024, 7, 1, 6, 1.5),
            ("c", 2024, 7, 1, 6, None),
            ("c", 2024, 7, 1, 6, -0.0),
            ("d", 2024, 7, 1, 6, 0.0),
            ("a", 2024, 7, 1, 7, 1.0),
        ],
    )
    out = mr.distinct_readings(
        mr.local_reads(mr.reads_of_sites(rows, sites(spark, "a", "b", "c", "d")))
    )
    assert [tuple(r) for r in out.collect()] == [
        (dt.datetime(2024, 7, 1, 0), 3, 4, 0.75),
        (dt.datetime(2024, 7, 1, 1), 1, 1, 1.0),
    ]


def test_duplicates_use_delivered_hours(spark, autumn):
    listed = sites(spark, "a", "b")
    assert mr.duplicate_reads(mr.reads_of_sites(autumn, listed)).isEmpty()
    twice = mr.reads_of_sites(autumn.union(autumn.filter("hour = 10")), listed)
    assert rows_of(mr.duplicate_reads(twice)) == [("b", 2024, 11, 3, 10, 2)]


def test_extract_is_one_local_day(spark, autumn):
    site_reads = mr.reads_of_sites(autumn, sites(spark, "a", "b", "x"))
    out = mr.hourly_extract(site_reads, ["a", "x"], dt.date(2024, 11, 2))
    assert rows_of(out) == [("a", 2024, 11, 2, 23, 1, 8.0)]
    out = mr.hourly_extract(site_reads, ["a", "x"], dt.date(2024, 11, 3))
    assert rows_of(out, "id", "hour", "n_observations", "total_kwh") == [
        ("a", 1, 2, 3.0),
        ("a", 2, 1, 4.0),
        ("x", 2, 1, 100.0),
    ]


def test_extract_east_of_utc(spark):
    rows = reads(spark, [("a", 2024, 6, 30, 20, 1.0), ("a", 2024, 7, 1, 20, 2.0)])
    site_reads = mr.reads_of_sites(rows, sites(spark, "a"))
    out = mr.hourly_extract(site_reads, ["a"], dt.date(2024, 7, 1), "Asia/Tokyo")
    assert rows_of(out, "day", "hour", "total_kwh") == [(1, 5, 1.0)]


def test_coverage_counts_listed_rows(spark, autumn):
    listed = sites(spark, "a", "b", "b", "nowhere", None)
    out = mr.site_coverage(listed, mr.reads_of_sites(autumn, listed))
    assert rows_of(out) == [(False, 2), (True, 3)]


def test_same_month_totals(spark):
    rows = reads(
        spark,
        [
            ("a", 2024, 7, 10, 6, 1.25),
            ("a", 2024, 7, 11, 6, 1.0),
            ("b", 2024, 7, 12, 6, 2.25),
            ("c", 2024, 7, 12, 6, 2.26),
            ("a", 2024, 8, 12, 6, 2.25),
            ("d", 2024, 7, 12, 6, None),
            ("e", 2024, 7, 12, 6, None),
        ],
    )
    local = mr.local_reads(mr.reads_of_sites(rows, sites(spark, *"abcde")))
    assert rows_of(mr.same_month_totals(local)) == [
        (2024, 7, 2.25, "a", 2),
        (2024, 7, 2.25, "b", 2),
    ]
    assert rows_of(mr.same_month_totals(local, places=1), "id", "n_sites") == [("a", 2), ("b", 2)]


def test_sketched_counts_unite(spark):
    reads = [(f"s{i % 300}", 2024, 7, 1 + i % 2, i % 24, None if i % 50 == 0 else float(i % 4000)) for i in range(20_000)]
    reads += [(None, 2024, 7, 1, 0, float("nan")), (None, 2024, 7, 1, 0, None), ("", 2024, 7, 1, 0, 0.0)]
    local = spark.createDataFrame(reads, "id string, year int, month int, day int, hour int, kwh double")
    sketches = mr.hour_sketches(local)
    assert sketches.count() == 24
    for grain in ("hour", "day", "month"):
        checked = mr.approximation_check(local, sketches, grain).collect()
        assert len(checked) == {"hour": 24, "day": 2, "month": 1}[grain]
        assert all(r["unique_kwh_readings_close"] and r["unique_sites_close"] for r in checked)
    month = mr.approximate_readings(sketches, "month").first()
    assert month["n_observations"] == len(reads)
    assert abs(month["unique_sites"] - 302) <= 8
