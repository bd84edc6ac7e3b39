"""Adapters that read the driver's tables as instrument data.

``embeddings`` stands in for spectra: ten consecutive vectors are the ten rows
of a file of a 64-pixel instrument; even files belong to the instrument with a
shutter (QE), odd files to the one without (HR). ``events`` gives file times,
temperatures and arrivals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.functions import radiometry as R
from verdance.functions.timekeys import file_name
from verdance.profiles import DARK_MODEL_BANDS, ExposureRule, InstrumentProfile
from verdance.sources.calibration import attach_in_force, vectors

EMB = InstrumentProfile(
    name="emb64",
    pixels=64,
    black=((1, 4), (61, 64)),
    band_nm=0.4,
    reference_pixel=24,
    exposure=ExposureRule(20250, 20400, 20150, 50, 2_000_000, 900_000),
    window=(21, 50),
    dark_limit=2500.0,
)
EMB_HR = EMB.variant(
    name="emb64hr", black=((1, 4),), dark="black", reference_pixel=40, window=None,
    display_clip=(10, 50), dark_limit=None,
)
EMB_HR_RAD_FIRST = EMB_HR.variant(name="emb64hrk", channel_order="rad_irr")
EMB_RAD_FIRST = EMB.variant(name="emb64k", channel_order="rad_irr", dark="plain")

PIXELS = {"QE": EMB.pixels, "HR": EMB_HR.pixels}
ROWS = EMB.rows_per_file
FILE_ID = f"vec_id div {ROWS}"
INSTRUMENT = "if(file_id % 2 = 0, 'QE', 'HR')"


# Given schemas spare a look into the files before every plan.
SCHEMAS = {
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def counts(embedding: str) -> str:
    """Vector to detector counts: black pixels sit near 1000, the rest near 20000."""
    level = f"if({R.is_black('i', EMB)}, 1000, 20000)"
    return f"transform({embedding}, (v, i) -> double(v) * 1000 + {level})"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spectrum: ``vec_id, file_id, row_no, counts``."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id",
        f"{FILE_ID} AS file_id",
        f"int(vec_id % {ROWS} + 1) AS row_no",
        f"{counts('embedding')} AS counts",
    )


def dark_array(embedding: str) -> str:
    """Measured dark spectrum; every seventh file has a stuck shutter."""
    level = "if(file_id % 7 = 3, 3000D, 1000D)"
    return f"transform({embedding}, (v, i) -> {level} + (i + 1) * 0.5D + double(v) * 20)"


WAVELENGTH = (
    f"transform(sequence(1, {EMB.pixels}),"
    " p -> p * 0.4D + p * p * 0.0005D + ((file_id % 10) * 0.01D + 740))"
)
T1 = "1000000 + file_id % 100 * 10000"
T2 = "2000000 + file_id % 100 * 5000"


def observations(spark: SparkSession, sf_dir: str, instrument: str | None = None) -> DataFrame:
    """One row per file with nested spectra, as the raw reader yields them.

    Files are assembled by one hash aggregation into a set of at most ten different
    rows, so a repeated row collapses in the map task; of two different rows with
    one number the smaller stays. A row that is missing keeps its place as NULL,
    so that no later row changes its channel. What is shuffled is the stored vector,
    not the counts made of it.
    """
    flat = table(spark, sf_dir, "embeddings").selectExpr(
        f"{FILE_ID} AS file_id", f"vec_id % {ROWS} AS r", "embedding"
    )
    if instrument is not None:
        flat = flat.where(f"{INSTRUMENT} = '{instrument}'")
    held = flat.groupBy("file_id").agg(F.expr("sort_array(collect_set(struct(r, embedding))) AS held"))

    def slot(k: int) -> str:
        # rows are in order: in a whole file the k-th is row k, and is looked for only where it is not the first such
        first = f"get(held, {k}).r = {k}" + (f" AND get(held, {k - 1}).r < {k}" if k else "")
        return f"if({first}, get(held, {k}), get(filter(held, s -> s.r = {k}), 0)).embedding AS e{k}"

    slots = held.selectExpr("file_id", *[slot(k) for k in range(ROWS)])
    rows = ", ".join(f"e{k}" for k in range(ROWS))
    return slots.selectExpr(
        "file_id",
        f"{INSTRUMENT} AS instrument",
        f"{T1} AS inte_t1_us",
        f"{T2} AS inte_t2_us",
        "array(1D, 1e-7D, 1e-13D, 0D, 0D, 0D, 0D, 0D) AS nl_coeff",
        f"{WAVELENGTH} AS wavelength",
        f"{dark_array('e0')} AS dark1",
        f"{dark_array('e1')} AS dark2",
        f"transform(array({rows}), e -> {counts('e')}) AS spectra",
    )


def calibration(spark: SparkSession) -> DataFrame:
    """Calibration of the stand-in instruments, one row per instrument, channel and pixel."""
    n = EMB.pixels
    return spark.range(0, 4 * n, 1, 1).selectExpr(
        f"if(id < {2 * n}, 'QE', 'HR') AS instrument",
        f"if(id % {2 * n} < {n}, 'irr', 'rad') AS channel",
        f"int(id % {n} + 1) AS pixel",
        f"""if(id < {2 * n}, 1D, 1.25D) * if(id % {2 * n} < {n},
            ((id % {n} + 1) * 0.01D + 5) * 2e-5D, ((id % {n} + 1) * 0.005D + 2) * 1.1e-7D) AS coef""",
    )


def band_width(spark: SparkSession) -> DataFrame:
    """Width of every pixel of the stand-in instruments."""
    n = EMB.pixels
    return spark.range(0, 2 * n, 1, 1).selectExpr(
        f"if(id < {n}, 'QE', 'HR') AS instrument",
        f"int(id % {n} + 1) AS pixel",
        f"0.4D + (id % {n} + 1) * 0.001D AS nm",
    )


def calibrated(
    spark: SparkSession, sf_dir: str, instrument: str | None = None, per_pixel: bool = False
) -> DataFrame:
    """Observations with their calibration arrays."""
    dim = vectors(calibration(spark), band_width(spark) if per_pixel else None, PIXELS)
    return observations(spark, sf_dir, instrument).join(dim, "instrument", "left")


def calibration_versions(spark: SparkSession) -> DataFrame:
    """Three versions of each stand-in calibration, half an hour apart between the instruments."""
    first = "if(instrument = 'QE', timestamp_ntz'2024-01-01 00:30:00', timestamp_ntz'2024-01-01 01:00:00')"
    return calibration(spark).selectExpr("*", "explode(sequence(0, 2)) AS version").selectExpr(
        "instrument", "channel", "pixel",
        f"{first} + make_dt_interval(0, version) AS valid_from",
        "coef * (1 + version * 0.1D) AS coef",
    )


def calibrated_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with time, name and the calibration in force."""
    obs = dated(observations(spark, sf_dir), spark, sf_dir)
    return attach_in_force(obs, vectors(calibration_versions(spark), pixels=PIXELS))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header values by file, taken from the event of the same number."""
    prefix = "if(file_id % 2 = 0, 'QE_PRO_', 'HR2000PLUS_')"
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "event_id AS file_id",
            "ts AS obs_ts",
            "value AS ambient_t",
            "-(value % 25) AS measurement_t",
            "user_id % 4 AS station",
        )
        .selectExpr("*", f"{file_name('obs_ts', prefix)} AS file_name")
    )


def dated(obs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with time, name and temperatures."""
    return obs.join(headers(spark, sf_dir), "file_id", "left")


def dark_models(spark: SparkSession) -> DataFrame:
    """Dark model of the stand-in instrument, one row per temperature band."""
    bands = spark.createDataFrame(
        [(i, *band) for i, band in enumerate(DARK_MODEL_BANDS)],
        "id INT, band STRING, temp_lo DOUBLE, temp_hi DOUBLE",
    )
    pixels = f"sequence(1, {EMB.pixels})"
    return bands.selectExpr(
        "band",
        "temp_lo",
        "temp_hi",
        f"transform({pixels}, p -> 900 + id * 20 + p * 0.4D) AS v1",
        f"transform({pixels}, p -> 5 + id + p * 0.01D) AS v2",
    )
