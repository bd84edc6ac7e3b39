"""Counts to flux: dark signal, detector response, calibration, reflectance.

All functions take and return SQL expression text (see ``functions.arrays``).
The scalar formulas serve exploded plans and array lambdas alike.
"""

from __future__ import annotations

from verdance.functions.arrays import bind, num, pick, record, strict_mean
from verdance.profiles import BARE_FIBRE, COSINE_CORRECTOR, InstrumentProfile, Optic

NL_TERMS = 8


# --- scalar formulas ------------------------------------------------------

def response_terms(coeffs: str) -> dict[str, str]:
    """The eight coefficients as scalars ``nl0`` .. ``nl7``; cheaper than array access."""
    return {f"nl{i}": f"get({coeffs}, {i})" for i in range(NL_TERMS)}


def linearise(signal: str, scope: str = "") -> str:
    """Divide by the detector response polynomial of degree seven.

    ``scope`` prefixes the names ``nl0`` .. ``nl7``, for instance ``b.``.
    """
    poly = f"{scope}nl{NL_TERMS - 1}"
    for i in range(NL_TERMS - 2, -1, -1):
        poly = f"({scope}nl{i} + {signal} * {poly})"
    return f"try_divide({signal}, {poly})"


def optic_of(which: str) -> Optic:
    return COSINE_CORRECTOR if which == "irr" else BARE_FIBRE


def factor(
    coef: str, time_us: str, profile: InstrumentProfile, which: str, band: str | None = None
) -> str:
    """Counts to mW m-2 sr-1 nm-1 for one pixel.

    ``band`` is the width of that pixel in nm; without it the profile's mean
    width is used.
    """
    scale = optic_of(which).throughput * 1e3
    width = num(scale * profile.band_nm) if band is None else f"{band} * {num(scale)}"
    return f"try_divide({coef}, {width} * (double({time_us}) / 1e6D))"


# --- rows and channels ----------------------------------------------------

def pair_no(row_no: str) -> str:
    return f"int(ceil({row_no} / 2))"


def channel(row_no: str, profile: InstrumentProfile) -> str:
    odd, even = ("irr", "rad") if profile.irr_parity == 1 else ("rad", "irr")
    return f"if({row_no} % 2 = 1, '{odd}', '{even}')"


def line_type(row_no: str) -> str:
    return f"int({row_no} % 2 + 1)"


def parity(profile: InstrumentProfile, which: str) -> int:
    """Position (1 or 2) of a channel's row inside a pair."""
    return profile.irr_parity if which == "irr" else 3 - profile.irr_parity


def by_parity(profile: InstrumentProfile, which: str, first: str, second: str) -> str:
    """Value that belongs to the rows of channel ``which``."""
    return first if parity(profile, which) == 1 else second


def is_black(index: str, profile: InstrumentProfile) -> str:
    """True for black pixels; ``index`` counts from zero."""
    hits = [f"{index} BETWEEN {lo - 1} AND {hi - 1}" for lo, hi in profile.black]
    return f"({' OR '.join(hits)})"


# --- dark signal ----------------------------------------------------------

def black_offset(spectra: str, profile: InstrumentProfile, which: str) -> str:
    """Mean over all black pixels of all rows of one channel of one file.

    NULL when a single black pixel is missing.
    """
    rows = f"filter({spectra}, (r, i) -> i % 2 = {parity(profile, which) - 1})"
    return strict_mean(f"flatten(transform({rows}, r -> {pick('r', profile.black)}))")


def spectrum_offset(counts: str, profile: InstrumentProfile) -> str:
    """Black-pixel mean of a single spectrum."""
    return strict_mean(pick(counts, profile.black))


def centre_dark(dark: str, profile: InstrumentProfile) -> str:
    """Dark spectrum minus the mean of its own black pixels."""
    mean = strict_mean(pick(dark, profile.black))
    return bind({"d": dark, "m": mean}, "dk", "transform(dk.d, v -> v - dk.m)")


def modelled_dark(v1: str, v2: str, time_us: str) -> str:
    """Dark spectrum from a straight line in exposure time, per pixel."""
    return bind(
        {"a": v1, "b": v2, "t": f"double({time_us}) / 1e6D"},
        "md",
        "zip_with(md.a, md.b, (p, q) -> p + q * md.t)",
    )


def subtract_dark(counts: str, dark: str | None, offset: str) -> str:
    if dark is None:
        return f"transform({counts}, s -> s - {offset})"
    return f"zip_with({counts}, {dark}, (s, d) -> s - d - {offset})"


# --- whole spectra --------------------------------------------------------

def factor_array(
    coef: str, time_us: str, profile: InstrumentProfile, which: str, band: str | None = None
) -> str:
    """:func:`factor` for every pixel, NULL at black pixels."""
    values = {"c": coef, "t": time_us} | ({} if band is None else {"w": band})
    one = factor("c", "fa.t", profile, which, None if band is None else "get(fa.w, i)")
    return bind(
        values, "fa", f"transform(fa.c, (c, i) -> if({is_black('i', profile)}, NULL, {one}))"
    )


def dark_columns(
    profile: InstrumentProfile, spectra: str, dark1: str | None, dark2: str | None
) -> dict[str, str]:
    """Per-channel offset (scalar) and dark spectrum for a profile."""
    out: dict[str, str] = {}
    for which in ("irr", "rad"):
        plain = profile.dark == "plain"
        out[f"off_{which}"] = "0D" if plain else black_offset(spectra, profile, which)
        if profile.dark != "black":
            raw = by_parity(profile, which, dark1, dark2)
            out[f"dark_{which}"] = centre_dark(raw, profile) if profile.dark == "centred" else raw
    return out


def flux_pairs(
    profile: InstrumentProfile,
    spectra: str = "spectra",
    nl_coeff: str = "nl_coeff",
    times: tuple[str, str] = ("inte_t1_us", "inte_t2_us"),
    coefs: tuple[str, str] = ("coef_irr", "coef_rad"),
    darks: tuple[str | None, str | None] = ("dark1", "dark2"),
    band: str | None = None,
) -> str:
    """``ARRAY<STRUCT<irr, rad>>`` of flux, one element per pair of rows."""
    dark = dark_columns(profile, spectra, *darks)
    values = {
        "s": spectra,
        **dark,
        **{
            f"f_{w}": factor_array(coef, by_parity(profile, w, *times), profile, w, band)
            for w, coef in zip(("irr", "rad"), coefs)
        },
        **response_terms(nl_coeff),
    }

    def one(which: str) -> str:
        row = f"get(b.s, 2 * k + {parity(profile, which) - 1})"
        name = f"dark_{which}"
        signal = subtract_dark(row, f"b.{name}" if name in dark else None, f"b.off_{which}")
        return f"zip_with({signal}, b.f_{which}, (y, f) -> {linearise('y', 'b.')} * f)"

    # sequence() would count down for a file without a complete pair
    index = "filter(sequence(0, greatest(size(b.s) div 2 - 1, 0)), k -> k < size(b.s) div 2)"
    both = record({w: one(w) for w in ("irr", "rad")})
    return bind(values, "b", f"transform({index}, k -> {both})")


def reflectance(irr: str, rad: str) -> str:
    return f"zip_with({rad}, {irr}, (r, i) -> try_divide(r, i))"
