"""Calibration tables: readers, collapsing to one array per channel, and the version in force."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdance.functions.arrays import finite
from verdance.profiles import HR, QE

#: Pixels of the instruments that a calibration has to cover.
PIXELS = {"QE": QE.pixels, "HR": HR.pixels}


def _whole(what: str, value: str, when: F.Column, length: F.Column | None, owner: F.Column) -> F.Column:
    """The values in pixel order as an array; an error names a table whose pixels are not 1, 2, ... to ``length``."""
    items = F.array_sort(F.collect_list(F.when(when, F.struct("pixel", value))))
    numbers = F.transform(items, lambda s: s["pixel"])
    full = F.size(items) if length is None else F.coalesce(length, F.size(items))
    good = numbers == F.when(full > 0, F.sequence(F.lit(1), full)).otherwise(numbers)
    error = F.raise_error(F.concat(F.lit(f"bad_calibration: pixels of {what} of "), owner))
    whole = F.coalesce(good & ~F.exists(numbers, lambda p: p.isNull()), F.lit(False))
    return F.when(whole, F.transform(items, lambda s: s[value])).otherwise(error.cast("array<double>"))


def vectors(
    calibration: DataFrame, band: DataFrame | None = None, pixels: Mapping[str, int] = PIXELS
) -> DataFrame:
    """One row per instrument: ``coef_irr, coef_rad`` and optionally ``band_nm``.

    Arrays are in pixel order and start at pixel 1. A table that is cut off, or in which a pixel is missing, doubled
    or without a number, would leave the rest of the flux empty or shift all later pixels. So it fails the job with the
    error ``bad_calibration`` and the instrument; ``pixels`` has the length of each detector (an instrument it doesn't
    name may have any, the same in both channels). A calibration is as long as its detector, so a group here is bounded.
    An instrument without widths has a NULL array.

    With a column ``valid_from`` there is one row per instrument and version, see :func:`attach_in_force`.
    """
    version = ["valid_from"] if "valid_from" in calibration.columns else []
    keys = ["instrument", *version]
    lengths = F.create_map(*[F.lit(x) for pair in pixels.items() for x in pair])
    expected = F.coalesce(F.try_element_at(lengths, F.col("instrument")), F.count_if(F.col("channel") == "irr").cast("int"))
    owner = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    out = calibration.groupBy(*keys).agg(
        _whole("irr", "coef", F.col("channel") == "irr", expected, owner).alias("coef_irr"),
        _whole("rad", "coef", F.col("channel") == "rad", expected, owner).alias("coef_rad"),
    )
    return out if band is None else out.join(widths(band, pixels), "instrument", "left")


def widths(band: DataFrame, pixels: Mapping[str, int] = PIXELS) -> DataFrame:
    """``band_nm``: one array per instrument, and version if there is ``valid_from``; checked like :func:`vectors`."""
    keys = ["instrument", *(["valid_from"] if "valid_from" in band.columns else [])]
    lengths = F.create_map(*[F.lit(x) for pair in pixels.items() for x in pair])
    owner = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    length = F.try_element_at(lengths, F.col("instrument"))
    return band.groupBy(*keys).agg(_whole("widths", "nm", F.lit(True), length, owner).alias("band_nm"))


# --- versions -----------------------------------------------------------------


def in_force(rows: DataFrame, versions: DataFrame, ts: str, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Add ``valid_from``: of the ``versions`` (``by``, valid_from) the last one that began at or before ``ts``.

    An as-of join without sorting or gathering the rows. The days on which there are rows and the versions of a ``by``
    group are put in order, and each day gets the version carried over from before and those that begin on it. Rows
    meet their day's few candidates by an equal key, which Spark broadcasts or splits by its size; a row's version is
    the last candidate not after it. Rows without a time, or before the first version, get NULL.
    """
    day = F.to_date(F.col(ts))
    days = rows.where(F.col(ts).isNotNull()).select(*by, day.alias("_day")).distinct()
    starts = versions.where(F.col("valid_from").isNotNull()).select(*by, F.to_date("valid_from").alias("_day"), "valid_from")
    calendar = (
        days.withColumn("valid_from", F.lit(None).cast("timestamp_ntz"))
        .unionByName(starts.withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz")))
        .groupBy(*by, "_day")
        .agg(F.collect_set("valid_from").alias("_new"))
    )
    before = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.array_max("_new"), ignorenulls=True).over(before)
    candidates = F.array_compact(F.concat(F.array(carried), "_new"))
    calendar = calendar.select(*by, "_day", candidates.alias("_candidates"))
    joined = rows.withColumn("_day", day).join(calendar, [*by, "_day"], "left")
    chosen = F.array_max(F.filter("_candidates", lambda v: v <= F.col(ts).cast("timestamp_ntz")))
    return joined.select(*rows.columns, chosen.alias("valid_from"))


def attach_in_force(
    obs: DataFrame, table: DataFrame, ts: str = "obs_ts", by: Sequence[str] = ("instrument",), status: str = "calibration_status"
) -> DataFrame:
    """Add the arrays of the calibration in force at ``ts``, its ``valid_from`` and a status.

    ``table`` has one row per ``by`` and ``valid_from`` (see :func:`vectors`, :func:`widths`). A file from before the
    first version, or without a time, keeps its row with NULL arrays and the status ``no_calibration``.
    """
    dated = in_force(obs, table.select(*by, "valid_from"), ts, by)
    out = dated.join(table.withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz")), [*by, "valid_from"], "left")
    known = F.when(F.col("valid_from").isNull(), "no_calibration").otherwise("ok")
    arrays = [c for c in table.columns if c not in (*by, "valid_from")]
    return out.select(*obs.columns, "valid_from", *arrays, known.alias(status))


_KEYED = T.StructType([T.StructField("key", T.StringType()), T.StructField("x", T.DoubleType())])


def _finite(value: F.Column) -> F.Column:
    """NULL is the only missing marker."""
    return F.when(F.abs(value) < float("inf"), value)


def _numbered(df: DataFrame) -> DataFrame:
    """Pixel number from the digits of the row key (``17`` or ``V17``)."""
    return df.withColumn("pixel", F.regexp_extract("key", r"(\d+)$", 1).try_cast("int"))


def read_coefficients(spark: SparkSession, path: str, instrument: str, channel: str) -> DataFrame:
    """Calibration file: header, row key and one coefficient per pixel.

    Further columns are ignored.
    """
    raw = spark.read.csv(path, header=True, schema=_KEYED, enforceSchema=True)
    return _numbered(raw).select(
        F.lit(instrument).alias("instrument"),
        F.lit(channel).alias("channel"),
        "pixel",
        F.expr(finite("x")).alias("coef"),
    )


def read_instrument_lines(spark: SparkSession, path: str, instrument: str, channel: str) -> DataFrame:
    """Vendor calibration file: nine header lines, then tab separated columns.

    The second column is the coefficient; pixels are numbered by line.
    """
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("l"))
    body = lines.select(F.posexplode(F.slice("l", 10, F.greatest(F.size("l") - 9, F.lit(0)))))
    return (
        body.where("trim(col) <> ''")
        .select(
            F.lit(instrument).alias("instrument"),
            F.lit(channel).alias("channel"),
            (F.col("pos") + 1).cast("int").alias("pixel"),
            _finite(F.get(F.split("col", r"\t"), F.lit(1)).try_cast("double")).alias("coef"),
        )
    )


def read_dark_model(
    spark: SparkSession, paths: dict[str, str], bands: tuple[tuple[str, float, float], ...], pixels: int | None = QE.pixels
) -> DataFrame:
    """Modelled-dark coefficients, one file per temperature band, as arrays.

    ``paths`` maps a band name to its file, which has columns ``V1`` and ``V2``,
    one row per pixel, and may start with a row key. A file whose pixels are not 1 to ``pixels`` (any number with
    None) fails with ``bad_calibration``; a value that is no finite number is NULL.
    """
    out = None
    for name, low, high in bands:
        # read as one text: a row without a key has its place in the file as pixel
        lines = spark.read.text(paths[name], wholetext=True).select(F.split("value", r"\r?\n").alias("l"))
        names = F.transform(F.split(F.get("l", F.lit(0)), ","), lambda c: F.trim(F.replace(c, F.lit('"'))))
        body = lines.select(names.alias("names"), F.posexplode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))))
        cells = body.where("trim(col) <> ''").select(
            "pos", "names", F.transform(F.split("col", ","), lambda c: F.trim(F.replace(c, F.lit('"')))).alias("c")
        )
        keyed = F.get("names", F.lit(0)) != "V1"

        def value(column: str) -> F.Column:
            return _finite(F.get("c", F.array_position("names", column).cast("int") - 1).try_cast("double"))

        part = cells.select(
            F.lit(name).alias("band"), F.lit(low).alias("temp_lo"), F.lit(high).alias("temp_hi"),
            F.when(keyed, F.regexp_extract(F.get("c", F.lit(0)), r"(\d+)$", 1).try_cast("int"))
            .otherwise((F.col("pos") + 1).cast("int")).alias("pixel"),
            value("V1").alias("v1"), value("V2").alias("v2"),
        )
        out = part if out is None else out.unionByName(part)
    length = None if pixels is None else F.lit(pixels)
    return out.groupBy("band", "temp_lo", "temp_hi").agg(
        *[_whole("dark model", v, F.lit(True), length, F.col("band")).alias(v) for v in ("v1", "v2")]
    )


def read_band_width(spark: SparkSession, path: str, instrument: str | None = None) -> DataFrame:
    """Width per pixel: a header and one number per line, in pixel order.

    Without ``instrument`` every file's own name, less its ending, tells whose widths it has.
    """
    lines = spark.read.text(path, wholetext=True)
    owner = F.regexp_replace("_metadata.file_name", r"\.csv$", "") if instrument is None else F.lit(instrument)
    split = lines.select(owner.alias("instrument"), F.split("value", r"\r?\n").alias("l"))
    body = split.select("instrument", F.posexplode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))))
    return body.where("trim(col) <> ''").select(
        "instrument",
        (F.col("pos") + 1).cast("int").alias("pixel"),
        _finite(F.trim("col").try_cast("double")).alias("nm"),
    )
