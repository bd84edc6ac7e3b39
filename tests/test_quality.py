import datetime as dt

import pytest

from verdance.functions.timekeys import quarter_hour
from verdance.operators.darkmodel import listed_bands, match_band, use_modelled_dark
from verdance.operators.quality import (
    exposure_advice,
    exposure_counts,
    exposure_flag,
    exposure_shares,
    missing_slots,
    shutter_status,
    temperature_quality,
)
from verdance.profiles import DARK_MODEL_BANDS, HR, QE


def test_shutter_limit_is_strict(spark):
    df = spark.createDataFrame(
        [(1, [2500.0] * 6), (2, [2501.0] * 6), (3, [0.0, 2400.0, 2602.0, 9000.0]), (4, [0.0, None])],
        "id int, dark array<double>",
    )
    out = df.selectExpr("id", f"{shutter_status('dark', QE)} AS s").collect()
    assert {r.id: r.s for r in out} == {1: "ok", 2: "shutter", 3: "shutter", 4: "no_dark"}


@pytest.mark.parametrize(
    "rule, peak, t, want",
    [
        (HR.exposure, 10_000, 50_000, 50_000),  # inside the target
        (HR.exposure, 12_000, 50_000, 50_000),  # limits belong to the target
        (HR.exposure, 12_001, 50_001, 32_500),  # too bright: 0.65, truncated
        (HR.exposure, 5_350, 50_000, 100_000),  # (9000 + 1000) / (5350 - 350)
        (HR.exposure, 350, 50_000, 5_000_000),  # at the floor: times 100
        (HR.exposure, 350, 200_000, 10_000_000),  # clamped above
        (QE.exposure, 150_000, 9_000, 8_000),  # clamped below
        (QE.exposure, 56_100, 1_000_000, 2_000_000),  # 110000 / 55000
        (HR.exposure, 350.0000001, 9_000_000, 10_000_000),  # huge ratio stays in range
    ],
)
def test_exposure_advice(spark, rule, peak, t, want):
    df = spark.createDataFrame([(float(peak), t)], "peak double, t long")
    assert df.selectExpr(f"{exposure_advice('peak', 't', rule)} AS a").first().a == want


def test_exposure_shares_from_counts(spark):
    df = spark.createDataFrame([("f", 8000.0), ("f", 9000.0), ("g", 13000.0), ("g", 10000.0)], "k string, p double")
    flagged = df.selectExpr("k", "'d' AS day", f"{exposure_flag('p', HR.exposure)} AS flag")
    out = exposure_shares(exposure_counts(flagged, ["k", "day"]), ["day"]).first()
    assert (out.n, out.share_under, out.share_ok, out.share_over) == (4, 0.25, 0.5, 0.25)


def test_dark_bands_are_open(spark):
    temps = [-19.5, -14.5, -10.0, -19.0, -20.0, -12.0, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(temps)], "id int, t double")
    bands = spark.createDataFrame(list(DARK_MODEL_BANDS), "band string, temp_lo double, temp_hi double")
    out = {r.id: r.band for r in match_band(df, listed_bands(bands), "t").collect()}
    assert [out[i] for i in range(7)] == ["M20", "M15", "M10", None, None, None, None]


def test_modelled_dark_replaces_measured(spark):
    obs = spark.createDataFrame(
        [(1, -10.0, 2_000_000, 500_000, [[1.0]]), (2, -5.0, 1, 1, [[1.0]])],
        "file_id int, measurement_t double, inte_t1_us long, inte_t2_us long, spectra array<array<double>>",
    ).selectExpr("*", "array(0D) AS dark1", "array(0D) AS dark2")
    bands = spark.createDataFrame(
        [("M10", -11.0, -9.0, [100.0, 200.0], [10.0, 20.0])],
        "band string, temp_lo double, temp_hi double, v1 array<double>, v2 array<double>",
    )
    out = {r.file_id: r for r in use_modelled_dark(obs, listed_bands(bands)).collect()}
    assert out[1].dark1 == [120.0, 240.0] and out[1].dark2 == [105.0, 210.0] and out[1].dark_status == "ok"
    assert out[2].spectra is None and out[2].dark_status == "no_dark_model"


def test_missing_slots(spark):
    def at(day, h, m):
        return dt.datetime(2024, 5, day, h, m)

    arrivals = [("QE", at(1, 6, 0)), ("QE", at(1, 6, 7)), ("QE", at(3, 20, 50)), ("QE", at(2, 23, 0)), ("HR", at(1, 12, 31))]
    df = spark.createDataFrame(arrivals, "instrument string, ts timestamp_ntz")
    df = df.selectExpr("instrument", f"{quarter_hour('ts')} AS bucket")
    gaps = missing_slots(df, ["instrument"], "bucket").toPandas()
    assert len(gaps[gaps.instrument == "QE"]) == 3 * 60 - 2
    assert len(gaps[gaps.instrument == "HR"]) == 59
    assert gaps.slot.min() == at(1, 6, 0) and gaps.slot.dt.time.max() == dt.time(20, 45)


def test_temperature_quality(spark):
    df = spark.createDataFrame([("d", -10.0), ("d", -12.0), ("d", None)], "day string, t double")
    out = temperature_quality(df, ["day"], "t").first()
    assert (out.n, out.mean_t, out.min_t, out.max_t, out.mean_off, out.n_off) == (2, -11.0, -12.0, -10.0, 1.0, 1)
