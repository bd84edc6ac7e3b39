"""Instrument profiles: plain configuration, one value per instrument set-up.

Pixel numbers are 1-based everywhere, as in the calibration files.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Optic:
    """Fore-optic geometry used to turn counts into flux."""

    solid_angle_sr: float
    area_m2: float

    @property
    def throughput(self) -> float:
        return self.solid_angle_sr * self.area_m2


# Geometry of the two fore-optics.
COSINE_CORRECTOR = Optic(math.pi, 1.95 * 1.95 * math.pi * 1e-6)
BARE_FIBRE = Optic(0.153721, 0.25 * math.pi * 1e-6)


@dataclass(frozen=True)
class ExposureRule:
    """Target range of the peak count and the step rule that approaches it."""

    dn_min: float
    dn_max: float
    floor: float
    step: float
    t_max_us: int
    t_min_us: int = 8000
    shrink: float = 0.65
    boost: float = 100.0


@dataclass(frozen=True)
class InstrumentProfile:
    name: str
    pixels: int
    black: tuple[tuple[int, int], ...]
    band_nm: float
    reference_pixel: int
    exposure: ExposureRule
    # 'centred': measured dark, centred, plus the pooled black-pixel offset
    # 'plain': measured dark only; 'black': pooled black-pixel offset only
    dark: str = "centred"
    channel_order: str = "irr_rad"
    window: tuple[int, int] | None = None
    # with a wavelength the window has the same number of pixels but begins, file by
    # file, at the first one that reaches it
    window_from_nm: float | None = None
    report_index: int = 18
    display_clip: tuple[int, int] | None = None
    dark_limit: float | None = None
    rows_per_file: int = 10

    def __post_init__(self) -> None:
        if self.dark not in ("centred", "plain", "black"):
            raise ValueError(f"unknown dark treatment: {self.dark}")
        if self.channel_order not in ("irr_rad", "rad_irr"):
            raise ValueError(f"unknown channel order: {self.channel_order}")

    @property
    def irr_parity(self) -> int:
        """Position (1 or 2) of the irradiance row inside a pair."""
        return 1 if self.channel_order == "irr_rad" else 2

    @property
    def n_black(self) -> int:
        return sum(hi - lo + 1 for lo, hi in self.black)

    @property
    def window_size(self) -> int:
        if self.window is None:
            raise ValueError(f"profile {self.name} has no fit window")
        return self.window[1] - self.window[0] + 1

    def is_black(self, pixel: int) -> bool:
        return any(lo <= pixel <= hi for lo, hi in self.black)

    def variant(self, **changes) -> "InstrumentProfile":
        return replace(self, **changes)


# The two field instruments.
QE = InstrumentProfile(
    name="QE",
    pixels=1044,
    black=((1, 4), (1041, 1044)),
    band_nm=59.28809 / 1043,
    reference_pixel=314,
    exposure=ExposureRule(100000, 140000, 1100, 10000, 30_000_000),
    window=(463, 551),
    dark_limit=2500.0,
)
HR = InstrumentProfile(
    name="HR",
    pixels=2048,
    black=((1, 18),),
    band_nm=918.1482 / 2047,
    reference_pixel=1225,
    exposure=ExposureRule(9000, 12000, 350, 1000, 10_000_000),
    dark="black",
    display_clip=(500, 1500),
)
# The later set-up: radiance first, measured dark used as it is.
QE_RAD_FIRST = QE.variant(channel_order="rad_irr", dark="plain")
HR_RAD_FIRST = HR.variant(channel_order="rad_irr")

FIXED_RUN_US = (2_000_000, 1_000_000)
TEC_SET_POINT_C = -10.0
# Open intervals of detector temperature for which a dark model exists.
DARK_MODEL_BANDS = (("M20", -20.0, -19.0), ("M15", -15.0, -14.0), ("M10", -11.0, -9.0))
SCHEDULE = {"first": "06:00", "last": "20:45", "minutes": 15}
