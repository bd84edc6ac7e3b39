"""Raw instrument files: discovery, parsing, rendering, quarantine.

One file is one row (``wholetext``), parsed with column expressions only. A
malformed file is a row with ``parse_error`` set, never a failed job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.functions import timekeys as K
from verdance.functions.arrays import finite
from verdance.profiles import HR, QE, InstrumentProfile

# Text of the raw file format.
LABEL_TIME = "observation date and time: "
LABEL_MODEL = "spectrometer: "
LABEL_AMBIENT = "ambient temperature: "
LABEL_MEASURE = "measuring temperature: "
LABEL_NL = "nonlinearity correction coefficients:"
LABEL_T1 = "integration time 1: "
LABEL_T2 = "integration time 2: "
MODELS = {"QE": "QE-PRO", "HR": "HR2000+"}

# 1-based line numbers of the two layouts.
QE_LINES = {
    "time": 1, "model": 3, "ambient": 4, "measure": 5, "nl": 7, "wavelength": 8,
    "t1": 9, "dark1": 10, "t2": 11, "dark2": 12, "spectra": 13,
}
HR_LINES = {"time": 1, "model": 3, "nl": 6, "wavelength": 7, "t1": 8, "t2": 9, "spectra": 11}

PROFILES = {"QE": QE, "HR": HR}


def discover(
    spark: SparkSession, path: str, streaming: bool = False, station: str | None = None
) -> DataFrame:
    """CSV files below ``path``: ``file_name, arrived, value`` (the whole text).

    Files of any name come, so that a misnamed one ends in the quarantine as
    ``unknown_file`` and not nowhere. Whole days can be pruned by pointing
    ``path`` at their folders. ``station`` is a pattern whose first group takes
    the station from the file's path; it becomes a column that :func:`parse`
    carries with ``keep=("station",)`` and the pairings take as a further key.
    """
    reader = spark.readStream if streaming else spark.read
    files = (
        reader.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .load(path)
    )
    named = files.selectExpr(
        "_metadata.file_name AS file_name",
        "_metadata.file_modification_time AS arrived",
        "value",
        "_metadata.file_path AS _path",
    )
    if station is not None:
        found = F.regexp_extract("_path", station, 1)
        named = named.withColumn("station", F.when(found != "", found))
    return named.drop("_path")


def read_exported(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Files written by :func:`export_raw`."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema("file_name STRING, value STRING").parquet(path)


def export_raw(files: DataFrame, path: str) -> None:
    """Write ``file_name, value`` as Parquet for transport: rows with equal names stay apart."""
    files.select("file_name", "value").write.parquet(path)


def best_delivery(observations: DataFrame, keys: tuple[str, ...] = ("file_name",)) -> DataFrame:
    """One row per file of a table of deliveries: a good one if there is any."""
    rest = [c for c in observations.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(F.col("parse_error").isNotNull(), F.xxhash64(*rest)))
    return observations.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def _number(text: str) -> str:
    return finite(f"try_cast({text} AS DOUBLE)")


def _numbers(line: str) -> str:
    return f"transform(split({line}, ','), n -> {_number('n')})"


def _after_colon(line: str) -> str:
    return f"get(split({line}, ': '), 1)"


def parse(
    files: DataFrame, profiles: Mapping[str, InstrumentProfile] = PROFILES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``file_name, value`` to observations, one row per file, good or bad.

    ``obs_ts`` is the time in the file name, which is the pairing key;
    ``header_ts`` the one in the header. ``short_file`` tells a file that ends
    behind a whole pair but too early: its pairs are used.  ``keep`` names further columns to carry.
    """
    rows = files.selectExpr(
        *keep,
        "file_name",
        f"{K.instrument_of('file_name')} AS instrument",
        f"{K.run_kind_of('file_name')} AS run_kind",
        f"{K.parse_name_time('file_name')} AS obs_ts",
        "split(value, '\\r?\\n') AS l",
    )

    def pick(name: str, make) -> str:
        """The value from its line in the layout of the file's instrument."""
        cases = []
        for instrument, layout in (("QE", QE_LINES), ("HR", HR_LINES)):
            if name in layout:
                cases.append(f"WHEN '{instrument}' THEN {make(f'get(l, {layout[name] - 1})')}")
        return f"CASE instrument {' '.join(cases)} END"

    def rows_from(layout: dict[str, int]) -> str:
        tail = f"slice(l, {layout['spectra']}, greatest(size(l) - {layout['spectra'] - 1}, 0))"
        return f"transform(filter({tail}, t -> trim(t) <> ''), t -> {_numbers('t')})"

    parsed = rows.selectExpr(
        *keep,
        "file_name",
        "instrument",
        "run_kind",
        "obs_ts",
        f"{pick('time', K.parse_header_time)} AS header_ts",
        f"{pick('model', _after_colon)} AS model",
        f"{pick('ambient', lambda t: _number(_after_colon(t)))} AS ambient_t",
        f"{pick('measure', lambda t: _number(_after_colon(t)))} AS measurement_t",
        f"{pick('t1', lambda t: f'try_cast({_after_colon(t)} AS BIGINT)')} AS inte_t1_us",
        f"{pick('t2', lambda t: f'try_cast({_after_colon(t)} AS BIGINT)')} AS inte_t2_us",
        f"{pick('nl', _numbers)} AS nl_coeff",
        f"{pick('wavelength', _numbers)} AS wavelength",
        f"{pick('dark1', _numbers)} AS dark1",
        f"{pick('dark2', _numbers)} AS dark2",
        f"CASE instrument WHEN 'QE' THEN {rows_from(QE_LINES)}"
        f" WHEN 'HR' THEN {rows_from(HR_LINES)} END AS spectra",
    )
    return parsed.selectExpr(
        "*",
        f"{K.quarter_hour('obs_ts')} AS bucket_ts",
        "size(spectra) AS n_rows",
        f"{_problem(profiles)} AS parse_error",
        f"size(spectra) < CASE instrument {_by_instrument(profiles, 'rows_per_file')} END AS short_file",
    ).drop("model")


def _by_instrument(profiles: Mapping[str, InstrumentProfile], field: str) -> str:
    return " ".join(f"WHEN '{i}' THEN {getattr(p, field)}" for i, p in profiles.items())


def _problem(profiles: Mapping[str, InstrumentProfile]) -> str:
    """Name of the first defect of a file, NULL for a good one."""
    models = " ".join(f"WHEN '{i}' THEN '{m}'" for i, m in MODELS.items())
    n = f"(CASE instrument {_by_instrument(profiles, 'pixels')} END)"
    return f"""CASE
        WHEN instrument IS NULL THEN 'unknown_file'
        WHEN NOT coalesce(trim(model) = CASE instrument {models} END, false) THEN 'not_a_spectrum'
        WHEN obs_ts IS NULL OR header_ts IS NULL THEN 'bad_time'
        WHEN inte_t1_us IS NULL OR inte_t2_us IS NULL
             OR coalesce(inte_t1_us <= 0 OR inte_t2_us <= 0, true) THEN 'bad_integration_time'
        WHEN coalesce(size(nl_coeff) <> 8 OR exists(nl_coeff, c -> c IS NULL), true)
             THEN 'bad_nonlinearity'
        WHEN coalesce(size(wavelength) <> {n}, true) THEN 'bad_length'
        WHEN instrument = 'QE' AND coalesce(size(dark1) <> {n} OR size(dark2) <> {n}, true)
             THEN 'bad_length'
        WHEN size(spectra) = 0 OR size(spectra) % 2 = 1 THEN 'bad_row_count'
        WHEN exists(spectra, r -> size(r) <> {n}) THEN 'bad_length'
    END"""


def good(observations: DataFrame) -> DataFrame:
    return observations.where("parse_error IS NULL").drop("parse_error")


def quarantine(observations: DataFrame) -> DataFrame:
    return observations.where("parse_error IS NOT NULL").select(
        "file_name", "instrument", "run_kind", "obs_ts", "n_rows", "parse_error"
    )


def render(instrument: str) -> str:
    """Expression for the raw text of an observation, in the layout of ``instrument``.

    Uses ``obs_ts, ambient_t, measurement_t, nl_coeff, wavelength, inte_t1_us,
    inte_t2_us, dark1, dark2, spectra``.
    """

    # a decimal cast prints fixed digits several times faster than a format string
    def fixed(value: str, digits: int) -> str:
        return f"coalesce(string(try_cast({value} AS DECIMAL(24, {digits}))), 'NA')"

    def joined(arr: str, one: str = fixed("v", 6)) -> str:
        return f"array_join(transform({arr}, v -> {one}), ',')"

    def text(label: str, value: str) -> str:
        return f"concat('{label}', {value})"

    head = [text(LABEL_TIME, K.clock_text("obs_ts")), "''", f"'{LABEL_MODEL}{MODELS[instrument]}'"]
    coeffs = [f"'{LABEL_NL}'", joined("nl_coeff", "format_string('%e', v)"), joined("wavelength")]
    t1, t2 = text(LABEL_T1, "inte_t1_us"), text(LABEL_T2, "inte_t2_us")
    if instrument == "QE":
        lines = [
            *head,
            text(LABEL_AMBIENT, fixed("ambient_t", 2)),
            text(LABEL_MEASURE, fixed("measurement_t", 2)),
            *coeffs, t1, joined("dark1"), t2, joined("dark2"), "''",
        ]
    else:
        lines = [*head, f"'{LABEL_AMBIENT}N/A'", *coeffs, t1, t2, "''"]
    rows = f"transform(spectra, r -> {joined('r')})"
    return f"concat(concat_ws('\\n', {', '.join(lines)}, {rows}), '\\n')"
