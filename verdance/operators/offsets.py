"""Dark offsets on flat tables (one row per spectrum)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import radiometry as R
from verdance.functions.arrays import pick, strict_sum
from verdance.profiles import InstrumentProfile


def pooled_offsets(rows: DataFrame, profile: InstrumentProfile) -> DataFrame:
    """Black-pixel mean per file and channel, from ``file_id, row_no, counts``.

    Each row is reduced to one sum before the shuffle. One missing black pixel
    voids the offset of its channel.
    """
    sums = rows.selectExpr(
        "file_id",
        f"{R.channel('row_no', profile)} AS channel",
        f"{strict_sum(pick('counts', profile.black))} AS s",
    )
    return sums.groupBy("file_id", "channel").agg(
        F.expr(f"if(count(s) = count(1), sum(s) / (count(1) * {profile.n_black}), NULL) AS offset")
    )


def spectrum_offsets(rows: DataFrame, profile: InstrumentProfile) -> DataFrame:
    """Black-pixel mean of every single spectrum."""
    return rows.selectExpr(
        "file_id", "row_no", f"{R.spectrum_offset('counts', profile)} AS offset"
    )


def readded(rows: DataFrame, profile: InstrumentProfile) -> DataFrame:
    """Variant: subtract the spectrum's own offset, linearise, add it back.

    Needs ``file_id, row_no, counts, nl_coeff``; one row per pixel.
    """
    terms = R.response_terms("nl_coeff")
    px = rows.selectExpr(
        "file_id",
        "row_no",
        f"{R.spectrum_offset('counts', profile)} AS offset",
        *[f"{e} AS {n}" for n, e in terms.items()],
        "posexplode(counts) AS (i, c)",
    )
    return px.selectExpr(
        "file_id",
        "row_no",
        "i + 1 AS pixel",
        f"{R.linearise('(c - offset)')} + offset AS value",
    )
