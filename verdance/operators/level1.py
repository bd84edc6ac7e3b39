"""From counts to flux, reflectance and fluorescence fits.

An observation is one row per file with the spectra nested in it, so all of
level 1 is narrow. Pixels are sliced before they are exploded, and the
arithmetic runs on exploded rows inside generated code. ``keys`` are carried
file columns that are functions of the file (its id, name, time, ...).

Expected columns: ``spectra, nl_coeff, inte_t1_us, inte_t2_us``, for measured
darks ``dark1, dark2``, for flux ``coef_irr, coef_rad`` and optionally
``band_nm`` (width per pixel), see :func:`attach_calibration`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from verdance.functions import radiometry as R
from verdance.functions.arrays import lower_bound, num, pick, pixels, strict_mean
from verdance.functions.lsq import fit_sums, line, merge_sums, solve_sums
from verdance.profiles import InstrumentProfile

CHANNELS = ("irr", "rad")


def named(exprs: Mapping[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in exprs.items()]


def attach_calibration(obs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add the calibration arrays of the instrument.

    ``vectors`` has one row per instrument (see ``sources.calibration``), a few
    arrays of pixel length; the caller marks it for broadcast after checking
    its size.
    """
    return obs.join(vectors, "instrument", "left")


def file_scalars(profile: InstrumentProfile) -> dict[str, str]:
    """Everything the per-pixel formulas need, computed once per file."""
    out = R.response_terms("nl_coeff")
    for which in CHANNELS:
        if profile.dark != "plain":
            out[f"off_{which}"] = R.black_offset("spectra", profile, which)
        if profile.dark == "centred":
            raw = R.by_parity(profile, which, "dark1", "dark2")
            out[f"dm_{which}"] = strict_mean(pick(raw, profile.black))
        out[f"t_{which}"] = R.by_parity(profile, which, "inte_t1_us", "inte_t2_us")
    return out


def pixel_vectors(
    profile: InstrumentProfile, obs: DataFrame, first: int, last: int, start: str | None = None
) -> dict[str, str]:
    """Per-pixel inputs, cut to the pixels in use; ``start`` as in :func:`pair_pixels`."""

    def cut(name: str) -> str:
        if start is not None:
            return f"slice({name}, {start}, {last - first + 1})"
        return name if (first, last) == (1, profile.pixels) else pixels(name, first, last)

    out: dict[str, str] = {}
    if profile.dark != "black":
        for which in CHANNELS:
            out[f"d_{which}"] = cut(R.by_parity(profile, which, "dark1", "dark2"))
    if "coef_irr" in obs.columns:
        out["k_irr"], out["k_rad"] = cut("coef_irr"), cut("coef_rad")
    if "band_nm" in obs.columns:
        out["w"] = cut("band_nm")
    return out


def corrected(profile: InstrumentProfile, which: str, counts: str, i: str) -> str:
    """Dark-corrected counts of one pixel."""
    value = counts
    if profile.dark == "plain":
        return f"({value} - get(d_{which}, {i}))"
    if profile.dark == "centred":
        value = f"{value} - (get(d_{which}, {i}) - dm_{which})"
    return f"({value} - off_{which})"


def flux(
    profile: InstrumentProfile, which: str, linear: str, i: str, span: tuple[int, int] | str, per_pixel: bool
) -> str:
    """Flux of one pixel, NULL at black pixels; ``i`` counts from the start of ``span``, or from the pixel it names."""
    scale = R.factor(
        f"get(k_{which}, {i})", f"t_{which}", profile, which, f"get(w, {i})" if per_pixel else None
    )
    value = f"{scale} * {linear}"
    if isinstance(span, str):
        return f"if({R.is_black(f'{i} + {span} - 1', profile)}, NULL, {value})"
    first, last = span
    if not any(lo <= last and first <= hi for lo, hi in profile.black):
        return value
    return f"if({R.is_black(f'{i} + {first - 1}', profile)}, NULL, {value})"


def spectrum_pixels(
    obs: DataFrame,
    profile: InstrumentProfile,
    keys: Sequence[str],
    first: int = 1,
    last: int | None = None,
) -> DataFrame:
    """One row per spectrum and pixel: ``counts, corrected, linear`` and ``flux``.

    Columns that are not selected downstream are never computed.
    """
    last = last or profile.pixels
    vectors = pixel_vectors(profile, obs, first, last)
    scalars = file_scalars(profile)
    whole = (first, last) == (1, profile.pixels)
    rows = "spectra" if whole else f"transform(spectra, r -> {pixels('r', first, last)})"
    px = (
        obs.selectExpr(*keys, *named(scalars), *named(vectors), f"{rows} AS rows")
        .selectExpr("*", "posexplode(rows) AS (r, row)")
        .selectExpr("*", "posexplode(row) AS (i, counts)")
    )
    irr = f"r % 2 = {profile.irr_parity - 1}"

    def either(make) -> str:
        return f"if({irr}, {make('irr')}, {make('rad')})"

    out = px.selectExpr("*", f"{either(lambda w: corrected(profile, w, 'counts', 'i'))} AS corrected")
    out = out.selectExpr("*", f"{R.linearise('corrected')} AS linear")
    last_col = []
    if "k_irr" in vectors:
        value = either(lambda w: flux(profile, w, "linear", "i", (first, last), "w" in vectors))
        last_col = [f"{value} AS flux"]
    return out.selectExpr(
        *keys,
        "r + 1 AS row_no",
        f"{R.pair_no('(r + 1)')} AS pair_no",
        f"if({irr}, 'irr', 'rad') AS channel",
        f"i + {first} AS pixel",
        "counts",
        "corrected",
        "linear",
        *last_col,
    )


def window_start(profile: InstrumentProfile, axis: str = "wavelength") -> str:
    """First pixel (from 1) whose wavelength reaches that of the profile's window."""
    return f"{lower_bound(axis, num(profile.window_from_nm), profile.pixels)} + 1"


def pair_pixels(
    obs: DataFrame,
    profile: InstrumentProfile,
    keys: Sequence[str],
    first: int = 1,
    last: int | None = None,
    start: str | None = None,
) -> DataFrame:
    """Irradiance and radiance of a pair side by side, one row per pixel.

    Also carries both values at the middle of the range (``irr_mid, rad_mid``).
    A file without spectra yields one row of NULLs, so no file is lost. ``start``
    names a column with the first pixel of each file in place of ``first``; the
    range keeps its length, unless the file ends before.
    """
    last = last or profile.pixels
    vectors = pixel_vectors(profile, obs, first, last, start)
    scalars = file_scalars(profile)
    per_pixel = "w" in vectors
    span = (first, last) if start is None else start
    origin = str(first) if start is None else start
    keys = [*keys, *([] if start is None else [start])]

    middle = str((last - first) // 2)

    def at_middle(which: str) -> str:
        signal = corrected(profile, which, f"get(c_{which}, {middle})", middle)
        return flux(profile, which, R.linearise(signal), middle, span, per_pixel)

    pairs = (
        obs.selectExpr(
            *keys,
            *named(scalars),
            *named(vectors),
            f"transform(spectra, r -> slice(r, {origin}, {last - first + 1})) AS rows",
            "if(size(spectra) > 1, sequence(0, size(spectra) div 2 - 1), NULL) AS pairs",
        )
        .selectExpr("*", "explode_outer(pairs) AS p")
        .selectExpr(
            "*",
            "int(p + 1) AS pair_no",
            *[f"get(rows, int(p * 2 + {R.parity(profile, w) - 1})) AS c_{w}" for w in CHANNELS],
        )
        .selectExpr("*", *[f"{at_middle(w)} AS {w}_mid" for w in CHANNELS])
    )
    px = pairs.selectExpr("*", "posexplode_outer(c_irr) AS (i, s_irr)").selectExpr(
        "*",
        f"{corrected(profile, 'irr', 's_irr', 'i')} AS x_irr",
        f"{corrected(profile, 'rad', 'get(c_rad, i)', 'i')} AS x_rad",
    )
    return px.selectExpr(
        *keys,
        "pair_no",
        f"i + {origin} AS pixel",
        *[f"{flux(profile, w, R.linearise(f'x_{w}'), 'i', span, per_pixel)} AS {w}" for w in CHANNELS],
        "irr_mid",
        "rad_mid",
    )


def reference_values(
    obs: DataFrame, profile: InstrumentProfile, prefix: str, which: str = "irr", n_pairs: int = 5
) -> DataFrame:
    """Add ``<prefix>1..n``: flux at the reference pixel for each pair.

    Chosen by channel, not by row parity, so both channel orders agree.
    """
    ref = profile.reference_pixel
    vectors = pixel_vectors(profile, obs, ref, ref)
    staged = obs.selectExpr("*", *named(file_scalars(profile)), *named(vectors))
    out = []
    for k in range(n_pairs):
        counts = f"get(get(spectra, {2 * k + R.parity(profile, which) - 1}), {ref - 1})"
        linear = R.linearise(corrected(profile, which, counts, "0"))
        out.append(f"{flux(profile, which, linear, '0', (ref, ref), 'w' in vectors)} AS {prefix}{k + 1}")
    return staged.selectExpr(*obs.columns, *out)


def reference_array(obs: DataFrame, profile: InstrumentProfile, name: str, which: str = "irr") -> DataFrame:
    """Add an array with the flux at the reference pixel of every pair of the file, however many there are.

    NULL for a file without spectra; chosen by channel, as :func:`reference_values`.
    """
    ref = profile.reference_pixel
    vectors = pixel_vectors(profile, obs, ref, ref)
    staged = obs.selectExpr("*", *named(file_scalars(profile)), *named(vectors))
    counts = f"get(get(spectra, int(p * 2 + {R.parity(profile, which) - 1})), {ref - 1})"
    linear = R.linearise(corrected(profile, which, counts, "0"))
    value = flux(profile, which, linear, "0", (ref, ref), "w" in vectors)
    pairs = f"if(size(spectra) > 1, transform(sequence(0, size(spectra) div 2 - 1), p -> {value}), NULL)"
    return staged.selectExpr(*obs.columns, f"{pairs} AS {name}")


def reference_flux(obs: DataFrame, profile: InstrumentProfile, keys: Sequence[str], which: str = "irr") -> DataFrame:
    """``keys, pair_no, value``: flux at the reference pixel by file and pair; a file without spectra has one NULL row."""
    held = reference_array(obs, profile, "_flux", which).selectExpr(*keys, "posexplode_outer(_flux) AS (_p, value)")
    return held.selectExpr(*keys, "_p + 1 AS pair_no", "value")


def fluorescence(obs: DataFrame, profile: InstrumentProfile, keys: Sequence[str]) -> DataFrame:
    """Fit ``L = c0 + c1*x + (c2 + c3*x)*E`` per file and pair over the window.

    ``x`` counts the window pixels from 1; ``c0 + c1*x`` is the fluorescence.
    Missing irradiance counts as zero. ``status`` says why a pair has no fit:
    ``no_signal`` (all irradiance or all radiance zero), ``bad_radiance`` (a
    missing value), ``singular``, ``missing`` (no such spectra, or too short for
    the window). Where the profile has a wavelength for it, the window begins by
    each file's own axis (``wavelength``), else at a fixed pixel.
    """
    return fluorescence_of(fluorescence_sums(obs, profile, keys), profile, [*keys, "pair_no"])


def fluorescence_sums(obs: DataFrame, profile: InstrumentProfile, keys: Sequence[str]) -> DataFrame:
    """The sums of every file's and pair's fit, with counts of ``rows``, ``rads``, ``dark_irr`` and ``dark_rad``."""
    first, last = profile.window
    n = profile.window_size
    mid, half = (n + 1) / 2, (n - 1) / 2
    start = None
    if profile.window_from_nm is not None:
        obs, start = obs.selectExpr("*", f"{window_start(profile)} AS _first"), "_first"
    origin = str(first) if start is None else start
    px = pair_pixels(obs, profile, keys, first, last, start).selectExpr(
        *keys,
        "pair_no",
        f"(pixel - {origin} + 1 - {num(mid)}) / {num(half)} AS x",
        "if(pixel IS NULL, NULL, coalesce(irr, 0D)) AS irr",
        "rad",
        "coalesce(irr_mid, 0D) AS irr_mid",
        "coalesce(rad_mid, 0D) AS rad_mid",
    )
    return fit_sums(
        px,
        [*keys, "pair_no"],
        y="rad",
        x="x",
        e="irr",
        e_shift="irr_mid",
        y_shift="rad_mid",
        extra=[
            "count(irr) AS rows",
            "count(rad) AS rads",
            "count_if(irr = 0) AS dark_irr",
            "count_if(rad = 0) AS dark_rad",
        ],
    )


def _unfit(n: int) -> str:
    """Why a pair has no fit, as far as its counts tell; NULL if it may have one."""
    return f"""CASE WHEN rows <> {n} THEN 'missing'
                    WHEN dark_irr = rows THEN 'no_signal'
                    WHEN rads <> rows THEN 'bad_radiance'
                    WHEN dark_rad = rows THEN 'no_signal' END"""


def merged_fluorescence_sums(sums: DataFrame, profile: InstrumentProfile, keys: Sequence[str]) -> DataFrame:
    """Sums of whole pairs merged to coarser ``keys`` (with ``pair_no`` or without), and their number ``n_pairs``.

    Takes rows of :func:`fluorescence_sums`, where only pairs with a fit of their own count, or rows merged before.
    """
    if "n_pairs" not in sums.columns:
        sums = sums.where(f"({_unfit(profile.window_size)}) IS NULL").selectExpr("*", "1L AS n_pairs")
    return merge_sums(sums, keys, ["sum(n_pairs) AS n_pairs"])


def fluorescence_of(sums: DataFrame, profile: InstrumentProfile, keys: Sequence[str]) -> DataFrame:
    """Fits from sums per pair, or merged ones; columns as :func:`fluorescence`."""
    n = profile.window_size
    mid, half = (n + 1) / 2, (n - 1) / 2
    own = "n_pairs" not in sums.columns
    reason = _unfit(n) if own else "NULL"
    status = f"coalesce({reason}, if(c3 IS NULL, 'singular', 'ok')) AS status"
    natural = {
        "c0": f"c0 - c1 * {num(mid / half)}",
        "c1": f"c1 / {num(half)}",
        "c2": f"c2 - c3 * {num(mid / half)}",
        "c3": f"c3 / {num(half)}",
        "sif": f"c0 + c1 * {num((profile.report_index - mid) / half)}",
        "rsq": "rsq",
    }
    return solve_sums(sums).selectExpr("*", status).selectExpr(
        *keys,
        *([] if own else ["n_pairs"]),
        "status",
        *[f"if(status = 'ok', {e}, NULL) AS {n}" for n, e in natural.items()],
    )


def curves(fits: DataFrame, profile: InstrumentProfile) -> DataFrame:
    """Add the fluorescence and slope lines over the window, as arrays."""
    n = profile.window_size
    return fits.selectExpr(
        "*", f"{line('c0', 'c1', n)} AS sif_line", f"{line('c2', 'c3', n)} AS slope_line"
    )


def flux_table(obs: DataFrame, profile: InstrumentProfile, keys: Sequence[str]) -> DataFrame:
    """Calibrated flux at rest: one row per pair with whole-spectrum arrays.

    Array lambdas cost about three times the exploded form per pixel, but
    the spectra need no shuffle to become arrays again.
    """
    pairs = R.flux_pairs(profile, band="band_nm" if "band_nm" in obs.columns else None)
    return (
        obs.selectExpr(*keys, f"posexplode({pairs}) AS (p, pair)")
        .selectExpr(*keys, "p + 1 AS pair_no", "pair.irr AS irr", "pair.rad AS rad")
        .selectExpr("*", f"{R.reflectance('irr', 'rad')} AS reflectance")
    )
