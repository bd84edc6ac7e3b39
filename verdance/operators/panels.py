"""Long tables behind the five panels drawn for every file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions.arrays import num
from verdance.functions.radiometry import line_type, parity
from verdance.operators.level1 import fluorescence, pair_pixels, spectrum_pixels
from verdance.profiles import InstrumentProfile

HEADROOM = 1.1
COLUMNS = ("panel", "pair_no", "channel", "line_type", "pixel", "wavelength", "value")


def spectrum_series(obs: DataFrame, profile: InstrumentProfile, keys: Sequence[str]) -> DataFrame:
    """Flux (ten lines per file) and reflectance (five) in one pass over the pixels.

    Lines are coloured by pair; the line type follows the parity of the row.
    """
    px = pair_pixels(obs, profile, [*keys, "wavelength"]).where("pixel IS NOT NULL")
    irr, rad = (line_type(str(parity(profile, w))) for w in ("irr", "rad"))
    lines = f"""stack(3, 'flux', 'irr', {irr}, irr,
                         'flux', 'rad', {rad}, rad,
                         'reflectance', 'both', 1, try_divide(rad, irr))
                AS (panel, channel, line_type, value)"""
    out = px.selectExpr(
        *keys, "pair_no", "pixel", "get(wavelength, pixel - 1) AS wavelength", lines
    )
    return out.select(*keys, *COLUMNS)


def sif_series(obs: DataFrame, profile: InstrumentProfile, keys: Sequence[str]) -> DataFrame:
    """Fluorescence line over the fit window; NULL values for a pair without a fit."""
    first = profile.window[0]
    fits = fluorescence(obs, profile, keys)
    rows = fits.join(obs.select(*keys, "wavelength"), list(keys)).selectExpr(
        *keys, "pair_no", "wavelength", "c0", "c1",
        f"explode(sequence(1, {profile.window_size})) AS x",
    )
    return rows.selectExpr(
        *keys,
        "'sif' AS panel",
        "pair_no",
        "'both' AS channel",
        "1 AS line_type",
        f"x + {first - 1} AS pixel",
        f"get(wavelength, x + {first - 2}) AS wavelength",
        "c0 + c1 * x AS value",
    )


def panel_table(obs: DataFrame, profile: InstrumentProfile, keys: Sequence[str]) -> DataFrame:
    """All panels of one instrument; the fluorescence panel where it has a window."""
    out = spectrum_series(obs, profile, keys)
    return out if profile.window is None else out.unionByName(sif_series(obs, profile, keys))


def panel_ranges(obs: DataFrame, profile: InstrumentProfile, keys: Sequence[str]) -> DataFrame:
    """Axis limits of the flux panel: 1.1 times the largest flux inside the clip."""
    first, last = profile.display_clip or (1, profile.pixels)
    axis = obs.selectExpr(
        "*", "array_min(wavelength) AS x_min", "array_max(wavelength) AS x_max"
    )
    held = [*keys, "x_min", "x_max"]
    px = spectrum_pixels(axis, profile, held, first, last)
    return px.groupBy(*held).agg(F.expr(f"max(flux) * {num(HEADROOM)} AS y_max"))
