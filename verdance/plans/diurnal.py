"""The diurnal product: one row per file of the fluorescence instrument."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions.timekeys import day_key, quarter_hour
from verdance.operators.level1 import fluorescence, reference_values
from verdance.operators.pairing import ordinal, pair_first_match
from verdance.operators.quality import shutter_status
from verdance.profiles import InstrumentProfile

PAIRS = 5

# The published columns, in order.
COLUMNS = (
    ["date"]
    + [f"SIF{k}" for k in range(1, PAIRS + 1)]
    + [f"RSQ{k}" for k in range(1, PAIRS + 1)]
    + ["temp_ambient", "temp_measure"]
    + [f"irr_750_QE{k}" for k in range(1, PAIRS + 1)]
    + [f"irr_750_HR{k}" for k in range(1, PAIRS + 1)]
)
_QE = [f"irr_750_QE{k}" for k in range(1, PAIRS + 1)]
_HR = [f"irr_750_HR{k}" for k in range(1, PAIRS + 1)]
#: Names begin with the instrument, month, day and hour; their first letters never fall along their order.
HOUR_OF_NAME = "substring(file_name, 1, 20)"
_HEAD = ["file_name", "obs_ts", "ambient_t", "measurement_t"]


def _checks(obs: DataFrame, profile: InstrumentProfile) -> str:
    """Status of a file before its fit: of the shutter, then of the calibration where versions were attached."""
    shutter = shutter_status("dark1", profile)
    if "calibration_status" not in obs.columns:
        return shutter
    return f"if({shutter} = 'ok', calibration_status, {shutter})"


def diurnal_long(obs: DataFrame, profile: InstrumentProfile, by: Sequence[str] = ()) -> DataFrame:
    """One row per file and pair, however many pairs a file has, with the full time.

    The companion of the published wide table, which has five slots and a day of
    the year: ``file_id``, the ``by`` columns, ``file_name, obs_ts, year, pair_no, status, sif, rsq``.
    """
    checked = obs.selectExpr("*", f"{_checks(obs, profile)} AS shutter")
    fits = fluorescence(checked, profile, ["file_id", *by, "file_name", "obs_ts", "shutter"])
    return fits.selectExpr(
        "file_id",
        *by,
        "file_name",
        "obs_ts",
        "year(obs_ts) AS year",
        "pair_no",
        "if(shutter = 'ok', status, shutter) AS status",
        "if(shutter = 'ok', sif, NULL) AS sif",
        "if(shutter = 'ok', rsq, NULL) AS rsq",
    )


def diurnal(
    qe_obs: DataFrame,
    hr_obs: DataFrame,
    qe: InstrumentProfile,
    hr: InstrumentProfile,
    pairing: str = "bucket",
    by: Sequence[str] = (),
) -> DataFrame:
    """Wide table keyed by ``file_id``, with ``file_name`` and ``status`` added.

    ``by`` names columns of both inputs that partners share, such as the station;
    they become columns of the table. ``n_pairs`` tells a file with more pairs than
    the five published slots: :func:`diurnal_long` and ``reference_flux`` have them all.

    A file with a failed shutter check keeps its row, all values NULL. With
    ``pairing='bucket'`` the partner is the first file (by name) of the same
    quarter-hour; with ``'position'`` the n-th file of the same day. A file
    without partner has NULL partner columns.

    The spectra are read once and never shuffled: the fits leave one row of
    sums per pair, the partner side one row of five values per quarter-hour.
    """
    if pairing not in ("bucket", "position"):
        raise ValueError(f"unknown pairing: {pairing}")
    checked = qe_obs.selectExpr(
        "*", f"{_checks(qe_obs, qe)} AS shutter", "int(if(size(spectra) > 1, size(spectra) div 2, 0)) AS n_pairs"
    )
    checked = checked.withColumn("spectra", F.expr("if(shutter = 'ok', spectra, NULL)"))
    head = reference_values(checked, qe, "irr_750_QE", n_pairs=PAIRS)
    held = ["file_id", *by, *_HEAD, "shutter", "n_pairs", *_QE]
    fits = fluorescence(head, qe, held)
    slots = [
        F.expr(f"max(if(pair_no = {k}, {value}, NULL)) AS {name}{k}")
        for name, value in (("SIF", "sif"), ("RSQ", "rsq"))
        for k in range(1, PAIRS + 1)
    ]
    wide = fits.groupBy(*held).agg(*slots)
    wide = wide.selectExpr(
        "*",
        "shutter AS status",
        f"if(shutter = 'ok', {day_key('obs_ts')}, NULL) AS date",
        "if(shutter = 'ok', ambient_t, NULL) AS temp_ambient",
        "if(shutter = 'ok', measurement_t, NULL) AS temp_measure",
    )
    partner = reference_values(hr_obs, hr, "irr_750_HR", n_pairs=PAIRS).selectExpr(
        "file_id AS hr_id", *by, "file_name AS hr_name", "obs_ts AS hr_ts", *_HR
    )
    if pairing == "bucket":
        joined = _by_bucket(wide, partner, qe_obs, by)
    else:
        joined = _by_position(wide, partner.drop(*by), qe_obs, hr_obs, by)
    own = [c for c in COLUMNS if c not in _HR]
    theirs = [f"if(status = 'ok', {c}, NULL) AS {c}" for c in _HR]
    return joined.selectExpr("file_id", *by, "file_name", "status", "n_pairs", *own, *theirs)


def _by_bucket(wide: DataFrame, partner: DataFrame, qe_obs: DataFrame, by: Sequence[str]) -> DataFrame:
    lhs = wide.selectExpr("*", f"if(status = 'ok', {quarter_hour('obs_ts')}, NULL) AS bucket")
    rhs = partner.selectExpr("*", f"{quarter_hour('hr_ts')} AS bucket")
    # how many files a quarter-hour has is counted in their headers, without the spectra
    heads = qe_obs.selectExpr(*by, f"{quarter_hour('obs_ts')} AS bucket")
    return pair_first_match(lhs, rhs, "bucket", ["hr_name", "hr_ts"], _HR, "file_id", by=by, sizes_of=heads)


def _by_position(
    wide: DataFrame, partner: DataFrame, qe_obs: DataFrame, hr_obs: DataFrame, by: Sequence[str]
) -> DataFrame:
    """Positions come from the file headers alone; spectra take no part in the sort."""

    def numbered(obs: DataFrame, name: str) -> DataFrame:
        heads = obs.selectExpr(f"file_id AS {name}", *by, "file_name", "to_date(obs_ts) AS day")
        # the name up to the hour
        return ordinal(heads, [*by, "day"], ["file_name", name], cell=HOUR_OF_NAME).select(name, *by, "day", "n")

    matched = numbered(qe_obs, "file_id").join(numbered(hr_obs, "hr_id"), [*by, "day", "n"], "left")
    values = partner.drop("hr_name", "hr_ts")
    found = wide.join(matched.select("file_id", "hr_id"), "file_id", "left")
    return found.join(values, "hr_id", "left")


def refresh(obs: DataFrame, is_new: str, path: str, build: Callable[[DataFrame], DataFrame], by: Sequence[str] = ("station",)) -> None:
    """Bring a published table up to date after files arrived, however late.

    Partners meet within a station and day, so a file changes nothing outside its own. The days with a row for which
    ``is_new`` holds (a condition on ``obs``, such as ``batch > 17``) are built again from all their files and written
    over; other days are neither read nor written. ``build`` makes the table from observations, with ``file_id`` and
    the ``by`` columns; folders are ``by`` and ``day``. Rerun after a failure it leaves the same table. Files without a
    time belong to no day and are left out.
    """
    day = "obs_date" if "obs_date" in obs.columns else "_day"
    dated = obs if day == "obs_date" else obs.withColumn(day, F.to_date("obs_ts"))
    dirty = dated.where(f"({is_new}) AND {day} IS NOT NULL").select(*[F.col(c).alias(f"_new_{c}") for c in (*by, day)]).distinct()
    same = [dated[day] == dirty[f"_new_{day}"], *[dated[c].eqNullSafe(dirty[f"_new_{c}"]) for c in by]]
    rows = dated.join(dirty, same, "left_semi")
    table = build(rows)
    days = rows.selectExpr("file_id AS _id", f"{day} AS day").distinct()
    out = table.join(days, table["file_id"] == days["_id"]).drop("_id")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "day").parquet(path)
