"""Tables and files the jobs publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.operators.pairing import ordinal
from verdance.plans.diurnal import COLUMNS, HOUR_OF_NAME
from verdance.sources.rawfiles import write_files


def write_observations(observations: DataFrame, path: str) -> None:
    """Compact many small files to Parquet, pruned by instrument and day.

    One shuffle gathers a day; the rebalance hint lets Spark split a busy day by
    its measured size. Bad files go to a partition of their own.
    """
    folders = ["parse_ok", "instrument", "obs_date"]
    dated = observations.selectExpr(
        "*", "to_date(obs_ts) AS obs_date", "parse_error IS NULL AS parse_ok"
    )
    dated.hint("rebalance", *folders).write.partitionBy(*folders).parquet(path)


def latest_day(diurnal: DataFrame) -> DataFrame:
    """Largest whole day on record; files without a date do not count."""
    return diurnal.agg(F.expr("bigint(floor(max(date))) AS latest_day"))


def write_diurnal_csv(diurnal: DataFrame, folder: str) -> str:
    """Write ``<latest day>sif.csv`` below ``folder``: row number and the 23 columns.

    Rows are in file name order. Returns the path.
    """
    numbered = ordinal(diurnal.select("file_name", *COLUMNS), [], ["file_name"], "row", cell=HOUR_OF_NAME)
    day = latest_day(numbered).first()["latest_day"]
    path = f"{folder.rstrip('/')}/{'NA' if day is None else day}sif.csv"
    numbered.select("row", *COLUMNS).orderBy("row").write.option("header", True).option(
        "nullValue", "NA"
    ).csv(path)
    return path


def write_diurnal_table(diurnal: DataFrame, path: str, year: str) -> None:
    """Parquet by year and day of the year; ``year`` is a column."""
    diurnal.selectExpr("*", "int(floor(date)) AS doy").write.partitionBy(year, "doy").parquet(path)


def write_band_width(widths: DataFrame, folder: str) -> None:
    """``<instrument>.csv`` for every instrument: a header and one number per line in pixel order.

    An instrument's widths are as many as its pixels, so a file is one row of a table of files.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pixel", "nm"))), lambda s: F.coalesce(s["nm"].cast("string"), F.lit("NA")))
    text = F.concat(F.lit("x\n"), F.array_join(lines, "\n"), F.lit("\n"))
    files = widths.groupBy("instrument").agg(text.alias("value"))
    write_files(files.select(F.concat("instrument", F.lit(".csv")).alias("file_name"), "value"), folder)


def write_coefficients(calibration: DataFrame, folder: str, letter: str = "") -> None:
    """``<instrument>_<channel>.csv`` with a row key and one coefficient per pixel, as ``read_coefficients`` takes it."""
    items = F.array_sort(F.collect_list(F.struct("pixel", "coef")))
    row = lambda s: F.concat(F.lit(f'"{letter}'), s["pixel"], F.lit('",'), F.coalesce(s["coef"].cast("string"), F.lit("NA")))
    text = F.concat(F.lit('"","x"\n'), F.array_join(F.transform(items, row), "\n"), F.lit("\n"))
    files = calibration.groupBy("instrument", "channel").agg(text.alias("value"))
    write_files(files.select(F.concat("instrument", F.lit("_"), "channel", F.lit(".csv")).alias("file_name"), "value"), folder)


def write_panels(panels: DataFrame, path: str) -> None:
    """Chart data by panel."""
    panels.write.partitionBy("panel").parquet(path)
