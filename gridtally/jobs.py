"""Whole analyses, from files to report folders.

Each job reads its inputs, writes every table of one analysis below an output
folder, and returns the tables, among them a report of the cells that could not be read
(``cell_report``). Files are read, and documents parsed, once: what
several reports need is written as Parquet and read back, so no report recomputes it
and a lost executor costs only its own tasks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.functions import clock, missing
from gridtally.plans import event_savings, meter_reads, model_compare, samples
from gridtally.sources import documents
from gridtally.sources.sinks import write_csv, write_table
from gridtally.sources.tables import CellReport, read_csv

# Headers of the delivered files and the type of each column.
EXPORT_COLUMNS = {
    "item_id": "string",
    "timestamp": "utc",
    "metered_savings": "double",
    "Non-responsive": "boolean",
}
CUSTOMER_COLUMNS = {
    "customer_id": "string",
    **{flag: "string" for flag in event_savings.EVENT_FLAGS.values()},
}
METER_LIST_COLUMNS = {"meterId": "string"}
FRAME_COLUMNS = {"item_id": "string", "metered_savings": "double"}
READ_COLUMNS = {
    "Account #": "string",
    "Year": "int",
    "Month": "int",
    "Day": "int",
    "Hour": "int",
    "kWh": "double",
}
SITE_COLUMNS = {"model_id": "string"}


# -- readers ---------------------------------------------------------------------


def read_export(
    spark: SparkSession, path: str, report: CellReport | None = None, table: str | None = None
) -> DataFrame:
    export = read_csv(spark, path, EXPORT_COLUMNS, report=report, table=table)
    return export.withColumnRenamed("Non-responsive", "non_responsive")


def read_meter_list(
    spark: SparkSession, path: str, report: CellReport | None = None, table: str | None = None
) -> DataFrame:
    meters = read_csv(spark, path, METER_LIST_COLUMNS, report=report, table=table)
    return meters.withColumnRenamed("meterId", "meter_raw")


def read_frame(spark: SparkSession, path: str, report: CellReport | None = None) -> DataFrame:
    """Vendor sample frame; blank ids stay blank."""
    return read_csv(spark, path, FRAME_COLUMNS, blank_is_null=False, report=report, table="frame")


def read_hourly_reads(
    spark: SparkSession, path: str, report: CellReport | None = None
) -> DataFrame:
    names = {"Account #": "account_id", "kWh": "kwh"}
    reads = read_csv(spark, path, READ_COLUMNS, report=report, table="reads")
    return reads.withColumnsRenamed({c: names.get(c, c.lower()) for c in READ_COLUMNS})


# -- event savings ---------------------------------------------------------------


@dataclass(frozen=True)
class EventFiles:
    """Paths of one reporting round. ``exports`` maps event labels to files."""

    exports: Mapping[str, str]
    customers: str
    meter_lists: Sequence[str]
    initial_exports: Mapping[str, str] | None = None


def event_savings_report(
    spark: SparkSession, files: EventFiles, out: str, zone: str = clock.DENVER
) -> dict[str, DataFrame]:
    """Event tables, count reconciliation and the site export."""
    cells = CellReport()
    exports = {
        event: read_export(spark, path, cells, f"export {event}")
        for event, path in files.exports.items()
    }
    customers = read_csv(spark, files.customers, CUSTOMER_COLUMNS, report=cells, table="customers")
    lists = [
        read_meter_list(spark, path, cells, f"meter list {n}")
        for n, path in enumerate(files.meter_lists, 1)
    ]
    prepared = event_savings.savings_clean(
        event_savings.union_events(exports),
        event_savings.customer_flags(customers),
        event_savings.drop_list(*lists),
        zone,
    )
    clean = write_table(prepared, f"{out}/savings_clean", "event")

    # Small tables from which others follow are written, so the savings are not read again.
    combined = write_table(event_savings.interval_combined(clean), f"{out}/intervals")
    by_label = write_table(event_savings.exact_by_event_label(clean), f"{out}/label_intervals")
    in_order = missing.nulls_last("event", "interval")
    # Fixed values here and below: names of report tables, as their readers expect them.
    tables = {
        "summary": combined.drop("n_active", "n_inactive").orderBy(*in_order),
        "summary_by_event_label": event_savings.interval_by_event_label(clean, by_label),
        "event_totals": event_savings.event_totals(clean),
        "response_counts": combined.drop(
            "mw_reduction_active", "mw_reduction_inactive"
        ).orderBy(*in_order),
        "combined": combined.orderBy(*in_order),
        "event_rounded_totals": event_savings.event_rounded_totals(clean, by_label),
        "all_filters": combined.select("event", "interval").orderBy(*in_order),
        "flag_fanout": event_savings.flag_fanout(customers),
        "updated_savings": event_savings.site_export(clean),
    }
    if files.initial_exports:
        initial = {
            event: read_export(spark, path, cells, f"initial export {event}")
            for event, path in files.initial_exports.items()
        }
        superseded = event_savings.union_events(initial)
        tables["initial_totals"] = event_savings.export_totals(superseded)

    # One pass fills all rungs; the report files hold one rung each.
    ladder = write_table(
        event_savings.filter_ladder(clean, with_all_flags=True), f"{out}/ladder", "scenario"
    )
    for rung in [*event_savings.LADDER, event_savings.ALL_FLAGS]:
        tables[rung] = ladder.filter(F.col("scenario") == rung).drop("scenario")
    _write_all(tables, out, cells)
    return {"savings_clean": clean, **tables}


# -- meter reads -----------------------------------------------------------------


def meter_read_report(
    spark: SparkSession,
    reads_path: str,
    sites_path: str,
    out: str,
    zone: str = clock.DENVER,
    extract: tuple[Sequence[str], dt.date] | None = None,
) -> dict[str, DataFrame]:
    """Month, day and hour totals, distinct readings, coverage and duplicate checks.

    ``extract`` names sites and a local day whose hours are written as well.
    """
    cells = CellReport()
    reads = read_hourly_reads(spark, reads_path, cells)
    sites = read_csv(spark, sites_path, SITE_COLUMNS, report=cells, table="sites")
    # The file is read once; every report reads the table of the sites' reads.
    kept = meter_reads.with_local_time(meter_reads.reads_of_sites(reads, sites), zone)
    timed = write_table(
        meter_reads.in_storage_order(kept), f"{out}/site_reads", *meter_reads.STORED_BY
    )
    site_reads, local = timed.drop("local"), meter_reads.local_parts(timed)

    # Days and months add up from the hours.
    hours = write_table(meter_reads.read_totals(local, "hour"), f"{out}/hour_totals", "year")
    sketches = write_table(meter_reads.hour_sketches(local), f"{out}/hour_sketches", "year")
    days = meter_reads.coarser_totals(hours, "day")
    months = meter_reads.coarser_totals(hours, "month")
    tables = {
        "summary_month": meter_reads.in_time_order(months, "month"),
        "summary_day": meter_reads.in_time_order(days, "day"),
        "summary_hour": meter_reads.in_time_order(hours, "hour"),
        "distinct_readings": meter_reads.distinct_readings(local, hours),
        "distinct_readings_day": meter_reads.approximate_readings(sketches, "day"),
        "distinct_readings_month": meter_reads.approximate_readings(sketches, "month"),
        "duplicate_reads": meter_reads.duplicate_reads(site_reads),
        "site_coverage": meter_reads.site_coverage(sites, site_reads),
        "same_month_totals": meter_reads.same_month_totals(local),
    }
    if extract is not None:
        tables["extract"] = meter_reads.hourly_extract(site_reads, *extract, zone=zone)
    _write_all(tables, out, cells)
    return tables


# -- model outputs ---------------------------------------------------------------


def model_report(
    spark: SparkSession, documents_folder: str, frame_path: str, out: str
) -> dict[str, DataFrame]:
    """Model outputs per site next to the vendor's estimates."""
    every = documents.list_documents(spark, documents_folder)
    listed = documents.of_family(every, documents.SAVINGS_FAMILY)
    texts = documents.read_savings_documents(spark, documents_folder, every)
    # Documents are read and parsed once, and compared with the vendor once.
    read = write_table(documents.parse_savings(texts), f"{out}/parsed_documents")
    parsed = documents.with_unread(read, listed)
    modelled = write_table(
        model_compare.site_savings(model_compare.flatten(parsed)), f"{out}/site_savings"
    )
    cells = CellReport()
    frame = read_frame(spark, frame_path, cells)
    compared = write_table(model_compare.model_vs_vendor(modelled, frame), f"{out}/compared")
    tables = {
        "savings_processed": compared,
        "site_ids": modelled.select(F.col("id").alias("model_id")),
        "mean_difference": model_compare.mean_difference(compared),
        "difference_histogram": model_compare.difference_histogram(compared),
        "linear_fit": model_compare.linear_fit(compared),
        "load_report": documents.load_report(parsed),
        "rejects": documents.rejects(parsed),
        "reject_reasons": documents.reject_reasons(parsed),
    }
    _write_all(tables, out, cells)
    return tables


# -- samples ---------------------------------------------------------------------


def stratified_sample_report(
    spark: SparkSession,
    frame_path: str,
    out: str,
    n_negative: int = samples.NEGATIVE_SIZE,
    n_per_quartile: int = samples.QUARTILE_SIZE,
    seed: int | str = samples.SIMPLE_SEED,
) -> samples.Sample:
    """Draw and write the stratified sample and its check."""
    cells = CellReport()
    frame = read_frame(spark, frame_path, cells)
    sample = samples.stratified_sample(frame, n_negative, n_per_quartile, seed)
    drawn = samples.Sample(write_table(sample.rows, f"{out}/drawn"), sample.breaks)
    write_csv(drawn.ids(), f"{out}/sample", quote_all=True)
    write_csv(samples.sample_check(drawn), f"{out}/sample_check")
    write_csv(cells.table(spark), f"{out}/cell_report")
    return drawn


def simple_sample_report(
    spark: SparkSession,
    frame_path: str,
    out: str,
    n: int = samples.SIMPLE_SIZE,
    seed: int | str = samples.SIMPLE_SEED,
) -> DataFrame:
    """Draw and write the simple sample."""
    cells = CellReport()
    sample = samples.simple_sample(read_frame(spark, frame_path, cells), n, seed)
    write_csv(sample, f"{out}/sample")
    write_csv(cells.table(spark), f"{out}/cell_report")
    return sample


def _write_all(tables: dict[str, DataFrame], out: str, cells: CellReport) -> None:
    """Writes all tables, and then the cells that the passes counted."""
    for name, table in tables.items():
        write_csv(table, f"{out}/{name}")
    spark = next(iter(tables.values())).sparkSession
    tables["cell_report"] = cells.table(spark)
    write_csv(tables["cell_report"], f"{out}/cell_report")
