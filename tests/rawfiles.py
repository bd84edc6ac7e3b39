"""Synthetic raw files, written by plain Python so that the Spark renderer is checked too."""

from __future__ import annotations

import datetime as dt

import numpy as np

from verdance.profiles import BARE_FIBRE, COSINE_CORRECTOR, HR, QE, InstrumentProfile

N = 89
X = np.arange(1, N + 1)
IRR = 150 + 60 * np.cos(X / 9)
RAD = 1.2 + 0.004 * X + (0.35 + 0.0005 * X) * IRR
IDENTITY = [1.0] + [0.0] * 7


def coefs(profile: InstrumentProfile) -> tuple[np.ndarray, np.ndarray]:
    """Calibration with black pixels as useless as in real files."""
    p = np.arange(1, profile.pixels + 1)
    irr = (2.7 + 0.0001 * p) * 1e-5
    rad = (1.5 + 0.0001 * p) * 1e-8
    for lo, hi in profile.black:
        irr[lo - 1 : hi] = -0.7
        rad[lo - 1 : hi] = 311.0
    return irr, rad


def factors(profile, t_irr, t_rad):
    irr, rad = coefs(profile)
    f_irr = irr / COSINE_CORRECTOR.throughput / (t_irr / 1e6) / profile.band_nm / 1e3
    f_rad = rad / BARE_FIBRE.throughput / (t_rad / 1e6) / profile.band_nm / 1e3
    return f_irr, f_rad


def clock(ts: dt.datetime) -> str:
    return ts.strftime("%a %b ") + f"{ts.day:2d}" + ts.strftime(" %H:%M:%S %Y")


def name(ts: dt.datetime, prefix: str) -> str:
    return prefix + clock(ts)[4:].replace(" ", "_").replace(":", "_") + ".csv"


def line(values) -> str:
    return ",".join(f"{v:.6f}" for v in values)


def qe_file(ts, profile=QE, t=(1_500_000, 2_500_000), dark_level=1200.0, nl=IDENTITY, offset=900.0) -> str:
    """Ten spectra whose calibrated window holds IRR and RAD, whatever the dark signal."""
    px = np.arange(1, profile.pixels + 1)
    wavelength = 700 + 0.0568 * px
    # the mean over the black pixels is exactly the dark level
    pattern = 3.0 * np.sin(px / 50.0)
    for lo, hi in profile.black:
        pattern[lo - 1 : hi] = 0.0
    darks = [dark_level + pattern, dark_level + 50 + 2 * pattern]
    t_irr, t_rad = t if profile.irr_parity == 1 else t[::-1]
    f_irr, f_rad = factors(profile, t_irr, t_rad)
    first = profile.window[0] - 1

    def spectrum(values, factor, own_dark):
        flux = np.full(profile.pixels, 100.0)
        flux[first : first + N] = values
        counts = flux / factor
        if profile.dark == "plain":
            out = counts + own_dark
        else:
            out = counts + (own_dark - np.mean(own_dark[:4])) + offset
        for lo, hi in profile.black:
            out[lo - 1 : hi] = offset
        return out

    irr = lambda d: spectrum(IRR, f_irr, d)
    rad = lambda d: spectrum(RAD, f_rad, d)
    order = (irr, rad) if profile.irr_parity == 1 else (rad, irr)
    rows = [make(d) for _ in range(5) for make, d in zip(order, darks)]
    head = [
        f"observation date and time: {clock(ts)}", "", "spectrometer: QE-PRO",
        "ambient temperature: 31.25", "measuring temperature: -10.02",
        "nonlinearity correction coefficients:", ",".join(f"{c:e}" for c in nl), line(wavelength),
        f"integration time 1: {t[0]}", line(darks[0]), f"integration time 2: {t[1]}", line(darks[1]), "",
    ]
    return "\n".join(head + [line(r) for r in rows]) + "\n"


def hr_file(ts, level=50.0, t=(400_000, 600_000), profile=HR) -> str:
    """Flat flux: ``level`` for irradiance, a tenth for radiance."""
    px = np.arange(1, profile.pixels + 1)
    f_irr, f_rad = factors(profile, *t)
    rows = []
    for _ in range(5):
        for value, f in ((level, f_irr), (level / 10, f_rad)):
            counts = value / f + 70.0
            for lo, hi in profile.black:
                counts[lo - 1 : hi] = 70.0
            rows.append(counts)
    head = [
        f"observation date and time: {clock(ts)}", "", "spectrometer: HR2000+",
        "ambient temperature: N/A", "nonlinearity correction coefficients:",
        ",".join(f"{c:e}" for c in IDENTITY), line(300 + 0.4487 * px),
        f"integration time 1: {t[0]}", f"integration time 2: {t[1]}", "",
    ]
    return "\n".join(head + [line(r) for r in rows]) + "\n"


def calibration_csv(values, letter: str = "") -> str:
    return '"","x"\n' + "".join(f'"{letter}{i}",{v!r}\n' for i, v in enumerate(values.tolist(), 1))
