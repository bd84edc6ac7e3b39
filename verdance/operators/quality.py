"""Quality control: shutter, exposure, detector temperature, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions.arrays import bind, median, num
from verdance.profiles import SCHEDULE, TEC_SET_POINT_C, ExposureRule, InstrumentProfile


FLAGS = ("under", "ok", "over", "missing")


def shutter_status(dark: str, profile: InstrumentProfile) -> str:
    """``shutter`` when the median of the dark spectrum is above the limit, ``no_dark`` without a median."""
    return bind({"m": median(dark)}, "checked", f"CASE WHEN checked.m IS NULL THEN 'no_dark' WHEN checked.m > {num(profile.dark_limit)} THEN 'shutter' ELSE 'ok' END")


def exposure_flag(peak: str, rule: ExposureRule) -> str:
    return (
        f"CASE WHEN {peak} IS NULL THEN 'missing' WHEN {peak} > {num(rule.dn_max)} THEN 'over'"
        f" WHEN {peak} < {num(rule.dn_min)} THEN 'under' ELSE 'ok' END"
    )


def exposure_advice(peak: str, time_us: str, rule: ExposureRule) -> str:
    """Next integration time in whole microseconds, one step of the rule; NULL without a spectrum."""
    ratio = (
        f"CASE WHEN {peak} > {num(rule.dn_max)} THEN {num(rule.shrink)}"
        f" WHEN {peak} > {num(rule.floor)}"
        f" THEN {num(rule.dn_min + rule.step)} / ({peak} - {num(rule.floor)})"
        f" ELSE {num(rule.boost)} END"
    )
    # clamp before the cast: a tiny margin above the floor makes a huge ratio
    step = f"least(double({time_us}) * ({ratio}), {num(rule.t_max_us)})"
    return (
        f"CASE WHEN {peak} IS NULL THEN NULL"
        f" WHEN {peak} BETWEEN {num(rule.dn_min)} AND {num(rule.dn_max)} THEN bigint({time_us})"
        f" ELSE greatest(bigint({step}), bigint({rule.t_min_us})) END"
    )


def exposure_counts(peaks: DataFrame, keys: Sequence[str], flag: str = "flag") -> DataFrame:
    """Spectra per key: all, under-, well and over-exposed, missing."""
    counts = [F.expr(f"count_if({flag} = '{v}') AS n_{v}") for v in FLAGS]
    return peaks.groupBy(*keys).agg(F.expr("count(1) AS n"), *counts)


def exposure_shares(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares per (coarser) key from :func:`exposure_counts`."""
    shares = [F.expr(f"double(sum(n_{v})) / sum(n) AS share_{v}") for v in FLAGS]
    return counts.groupBy(*keys).agg(F.expr("sum(n) AS n"), *shares)


def temperature_quality(
    df: DataFrame, keys: Sequence[str], temperature: str, set_point: float = TEC_SET_POINT_C
) -> DataFrame:
    """Detector temperature against its set-point per key."""
    off = f"abs({temperature} - {num(set_point)})"
    aggs = {
        "n": f"count({temperature})",
        "mean_t": f"avg({temperature})",
        "min_t": f"min({temperature})",
        "max_t": f"max({temperature})",
        "mean_off": f"avg({off})",
        "n_off": f"count_if({off} > 1D)",
    }
    return df.groupBy(*keys).agg(*[F.expr(f"{e} AS {n}") for n, e in aggs.items()])


def missing_slots(arrivals: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Scheduled quarter-hours without a file, per key, first to last day on record.

    Arrivals are reduced to distinct slots first; both sides of the anti join
    then have one row per key and slot.
    """
    seen = arrivals.selectExpr(*keys, f"{bucket} AS slot").where("slot IS NOT NULL").distinct()
    span = seen.groupBy(*keys).agg(
        F.expr("to_date(min(slot)) AS first"), F.expr("to_date(max(slot)) AS last")
    )
    expected = span.selectExpr(
        *keys, "explode(sequence(first, last, interval 1 day)) AS day"
    ).selectExpr(
        *keys,
        f"""explode(sequence(cast(day AS TIMESTAMP_NTZ) + {_clock(SCHEDULE['first'])},
                             cast(day AS TIMESTAMP_NTZ) + {_clock(SCHEDULE['last'])},
                             interval {SCHEDULE['minutes']} minutes)) AS slot""",
    )
    return expected.join(seen, [*keys, "slot"], "left_anti")


def _clock(text: str) -> str:
    hours, minutes = text.split(":")
    return f"make_dt_interval(0, {int(hours)}, {int(minutes)}, 0)"
