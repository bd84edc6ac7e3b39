"""Modelled dark spectra, chosen by detector temperature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions.radiometry import modelled_dark


def match_band(df: DataFrame, bands: DataFrame, temperature: str) -> DataFrame:
    """Range join on open intervals ``temp_lo < t < temp_hi``; no band gives NULLs.

    Every band is listed under the whole degrees it touches, which turns the
    range join into an equi-join with a residual check. Bands do not overlap,
    so a row finds at most one. The caller marks ``bands`` for broadcast.
    """
    left = df.alias("l").selectExpr("l.*", f"int(floor(l.{temperature})) AS _degree")
    on = (
        F.expr("l._degree = b._degree")
        & F.expr(f"l.{temperature} > b.temp_lo")
        & F.expr(f"l.{temperature} < b.temp_hi")
    )
    kept = [f"l.{c}" for c in df.columns] + [f"b.{c}" for c in bands.columns if c != "_degree"]
    return left.alias("l").join(bands.alias("b"), on, "left").selectExpr(*kept)


def listed_bands(bands: DataFrame) -> DataFrame:
    """One row per band and whole degree it touches."""
    return bands.selectExpr(
        "*", "explode(sequence(int(floor(temp_lo)), int(floor(temp_hi)))) AS _degree"
    )


def use_modelled_dark(obs: DataFrame, bands: DataFrame) -> DataFrame:
    """Replace the measured dark spectra by modelled ones.

    ``bands`` is :func:`listed_bands` of a dark model (arrays ``v1, v2``). Files
    whose temperature is in no band lose their spectra and get the status
    ``no_dark_model``, so they stay in the result without values.
    """
    found = match_band(obs, bands, "measurement_t")
    kept = [c for c in obs.columns if c not in ("dark1", "dark2", "spectra")]
    return found.selectExpr(
        *kept,
        f"{modelled_dark('v1', 'v2', 'inte_t1_us')} AS dark1",
        f"{modelled_dark('v1', 'v2', 'inte_t2_us')} AS dark2",
        "if(v1 IS NULL, NULL, spectra) AS spectra",
        "if(v1 IS NULL, 'no_dark_model', 'ok') AS dark_status",
    )
