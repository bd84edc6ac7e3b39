"""From files on disk to the diurnal table, on the two real instrument profiles."""

import datetime as dt

import numpy as np
import pytest
import rawfiles as rf

from verdance.functions import timekeys as K
from verdance.operators.level1 import attach_calibration, fluorescence, flux_table
from verdance.plans.diurnal import COLUMNS, diurnal
from verdance.profiles import HR, HR_RAD_FIRST, QE, QE_RAD_FIRST
from verdance.sources import calibration as C
from verdance.sources import raw, sinks

T0 = dt.datetime(2016, 7, 8, 16, 0, 40)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def write(folder, name, text, newline="\n"):
    path = folder / name
    path.write_bytes(text.replace("\n", newline).encode())
    return path


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    good = rf.qe_file(T0)
    write(folder, rf.name(T0, "QE_PRO_"), good)
    write(folder, rf.name(minutes(15), "QE_PRO_"), rf.qe_file(minutes(15)), "\r\n")
    write(folder, rf.name(minutes(30), "QE_PRO_"), rf.qe_file(minutes(30), dark_level=2501.0))
    write(folder, rf.name(minutes(1), "fix_QE_PRO_"), rf.qe_file(minutes(1), t=(2_000_000, 1_000_000)))
    write(folder, rf.name(minutes(60), "QE_PRO_"), good[: len(good) // 2])
    write(folder, rf.name(minutes(61), "QE_PRO_"), "not a spectrum\n")
    nan_rad = good.split("\n")
    cells = nan_rad[14].split(",")
    cells[500] = "NaN"
    nan_rad[14] = ",".join(cells)
    write(folder, rf.name(minutes(90), "QE_PRO_"), "\n".join(nan_rad))
    nan_black = good.split("\n")
    cells = nan_black[13].split(",")
    cells[0] = "nan"
    nan_black[13] = ",".join(cells)
    write(folder, rf.name(minutes(105), "QE_PRO_"), "\n".join(nan_black))
    # two partners in one quarter-hour, the second by name first in time order does not matter
    write(folder, rf.name(minutes(3), "HR2000PLUS_"), rf.hr_file(minutes(3), level=60.0))
    write(folder, rf.name(minutes(2), "HR2000PLUS_"), rf.hr_file(minutes(2), level=50.0))
    write(folder, rf.name(minutes(31), "HR2000PLUS_"), rf.hr_file(minutes(31), level=70.0))
    write(folder, "notes.txt", "hello")
    write(folder, "other.csv", "1,2,3")
    return folder


@pytest.fixture(scope="module")
def parsed(spark, landing):
    return raw.parse(raw.discover(spark, str(landing))).cache()


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("calibration")
    parts = None
    for profile, letters in ((QE, ("", "V")), (HR, ("V", ""))):
        for which, values, letter in zip(("irr", "rad"), rf.coefs(profile), letters):
            path = folder / f"{profile.name}_{which}.csv"
            path.write_text(rf.calibration_csv(values, letter))
            part = C.read_coefficients(spark, str(path), profile.name, which)
            parts = part if parts is None else parts.unionByName(part)
    return C.vectors(parts)


def test_discovery_is_anchored(parsed):
    rows = parsed.collect()
    assert len(rows) == 12
    # a misnamed file is a row as well, and no instrument's
    assert [r.parse_error for r in rows if r.instrument is None] == ["unknown_file"]
    rows = [r for r in rows if r.instrument is not None]
    assert sorted({(r.instrument, r.run_kind) for r in rows}) == [("HR", "auto"), ("QE", "auto"), ("QE", "fixed")]


def test_a_short_file_keeps_its_pairs(spark, parsed):
    lines = rf.qe_file(T0).split("\n")
    text = "\n".join(lines[: 13 + 8]) + "\n"
    df = spark.createDataFrame([(rf.name(T0, "QE_PRO_"), text)], "file_name string, value string")
    row = raw.parse(df).first()
    assert (row.parse_error, row.n_rows, row.short_file) == (None, 8, True)
    assert not any(r.short_file for r in raw.good(parsed).collect())


def test_station_from_the_path(spark, tmp_path):
    """Two stations with a run in the same second stay two files, and pair within their station only."""
    for station in ("s1", "s2"):
        (tmp_path / station).mkdir()
        write(tmp_path / station, rf.name(T0, "QE_PRO_"), rf.qe_file(T0))
    found = raw.discover(spark, str(tmp_path), station=r"/([^/]+)/[^/]+$")
    rows = raw.parse(found, keep=("station",)).collect()
    assert sorted((r.station, r.parse_error) for r in rows) == [("s1", None), ("s2", None)]


def test_header_values(parsed):
    row = parsed.where(f"file_name = '{rf.name(T0, 'QE_PRO_')}'").first()
    assert rf.name(T0, "QE_PRO_") == "QE_PRO_Jul__8_16_00_40_2016.csv"
    assert row.obs_ts == T0 and row.header_ts == T0 and row.bucket_ts == dt.datetime(2016, 7, 8, 16, 0)
    assert (row.ambient_t, row.measurement_t) == (31.25, -10.02)
    assert (row.inte_t1_us, row.inte_t2_us, row.n_rows) == (1_500_000, 2_500_000, 10)
    assert row.nl_coeff == rf.IDENTITY
    assert len(row.wavelength) == len(row.dark1) == len(row.dark2) == 1044
    assert [len(s) for s in row.spectra] == [1044] * 10
    hr = parsed.where("instrument = 'HR'").first()
    assert hr.ambient_t is None and hr.dark1 is None and [len(s) for s in hr.spectra] == [2048] * 10


def test_defects_are_named_and_isolated(parsed):
    errors = {r.file_name: r.parse_error for r in raw.quarantine(parsed).collect()}
    assert errors == {
        rf.name(minutes(60), "QE_PRO_"): "bad_length",
        rf.name(minutes(61), "QE_PRO_"): "not_a_spectrum",
        "other.csv": "unknown_file",
    }
    assert raw.good(parsed).count() == 9


def test_renderer_writes_what_the_parser_reads(spark, parsed, tmp_path):
    good = raw.good(parsed).where("instrument = 'QE'")
    again = good.selectExpr("file_name", f"{raw.render('QE')} AS value")
    text = again.where(f"file_name = '{rf.name(T0, 'QE_PRO_')}'").first().value
    assert text == rf.qe_file(T0)
    hr = raw.good(parsed).where("instrument = 'HR'").selectExpr("file_name", f"{raw.render('HR')} AS value")
    assert hr.where(f"file_name = '{rf.name(minutes(2), 'HR2000PLUS_')}'").first().value == rf.hr_file(minutes(2))
    raw.export_raw(again, str(tmp_path / "export"))
    back = raw.parse(raw.read_exported(spark, str(tmp_path / "export")))
    assert back.count() == good.count()
    assert back.where("parse_error IS NOT NULL").count() == 0


def test_fluorescence_from_files(parsed, vectors):
    obs = attach_calibration(raw.good(parsed).where("instrument = 'QE'"), vectors)
    fits = {(r.file_name, r.pair_no): r for r in fluorescence(obs, QE, ["file_name"]).collect()}
    assert len(fits) == 6 * 5
    for ts, prefix in ((T0, "QE_PRO_"), (minutes(15), "QE_PRO_"), (minutes(1), "fix_QE_PRO_")):
        for k in range(1, 6):
            got = fits[rf.name(ts, prefix), k]
            assert got.status == "ok"
            np.testing.assert_allclose([got.sif, got.rsq], [1.272, 1.0], atol=2e-4)
    # a missing radiance pixel spoils its own pair only
    states = [fits[rf.name(minutes(90), "QE_PRO_"), k].status for k in range(1, 6)]
    assert states == ["bad_radiance", "ok", "ok", "ok", "ok"]
    # a missing black pixel voids the offset of its channel in the whole file
    assert {fits[rf.name(minutes(105), "QE_PRO_"), k].status for k in range(1, 6)} == {"no_signal"}


def test_flux_masks_black_pixels(parsed, vectors):
    obs = attach_calibration(raw.good(parsed).where(f"file_name = '{rf.name(T0, 'QE_PRO_')}'"), vectors)
    row = flux_table(obs, QE, ["file_name"]).where("pair_no = 3").first()
    assert [i + 1 for i, v in enumerate(row.irr) if v is None] == [1, 2, 3, 4, 1041, 1042, 1043, 1044]
    np.testing.assert_allclose(row.irr[462:551], rf.IRR, rtol=1e-7)
    np.testing.assert_allclose(row.rad[462:551], rf.RAD, rtol=1e-6)
    np.testing.assert_allclose(row.reflectance[462:551], rf.RAD / rf.IRR, rtol=1e-6)


def test_exposure_time_scales_flux(parsed, vectors):
    obs = attach_calibration(raw.good(parsed).where(f"file_name = '{rf.name(T0, 'QE_PRO_')}'"), vectors)
    slow = obs.withColumn("inte_t1_us", obs.inte_t1_us * 2)
    a = flux_table(obs, QE, ["file_name"]).first().irr[500]
    b = flux_table(slow, QE, ["file_name"]).first().irr[500]
    assert a / b == pytest.approx(2.0)


def test_adding_a_constant_to_dark_changes_nothing(parsed, vectors):
    obs = attach_calibration(raw.good(parsed).where(f"file_name = '{rf.name(T0, 'QE_PRO_')}'"), vectors)
    up = obs.selectExpr(
        *[c for c in obs.columns if c not in ("dark1", "spectra")],
        "transform(dark1, v -> v + 37) AS dark1",
        "transform(spectra, s -> transform(s, v -> v + 11)) AS spectra",
    )
    a = fluorescence(obs, QE, ["file_name"]).orderBy("pair_no").toPandas()
    b = fluorescence(up, QE, ["file_name"]).orderBy("pair_no").toPandas()
    np.testing.assert_allclose(a.sif, b.sif, rtol=1e-9)


def test_swapped_channel_order(spark, vectors):
    """The second set-up gives the same fluorescence and reflectance from swapped rows."""
    text = rf.qe_file(T0, QE_RAD_FIRST, t=(2_500_000, 1_500_000))
    files = spark.createDataFrame([(rf.name(T0, "QE_PRO_"), text)], "file_name string, value string")
    obs = attach_calibration(raw.parse(files), vectors)
    fits = fluorescence(obs, QE_RAD_FIRST, ["file_name"]).collect()
    assert len(fits) == 5
    for got in fits:
        np.testing.assert_allclose([got.sif, got.rsq], [1.272, 1.0], atol=2e-4)
    row = flux_table(obs, QE_RAD_FIRST, ["file_name"]).first()
    np.testing.assert_allclose(row.reflectance[462:551], rf.RAD / rf.IRR, rtol=1e-6)


@pytest.fixture(scope="module")
def product(parsed, vectors):
    good = attach_calibration(raw.good(parsed), vectors).selectExpr("file_name AS file_id", "*")
    qe = good.where("instrument = 'QE' AND run_kind = 'auto'")
    hr = good.where("instrument = 'HR'")
    return qe, hr


def test_diurnal_table(product):
    out = {r.file_name: r for r in diurnal(*product, QE, HR).collect()}
    assert len(out) == 5
    first = out[rf.name(T0, "QE_PRO_")]
    assert first.status == "ok"
    assert first.date == pytest.approx(189 + 16 / 24)
    assert [first[c] for c in ("temp_ambient", "temp_measure")] == [31.25, -10.02]
    np.testing.assert_allclose([first[f"SIF{k}"] for k in range(1, 6)], [1.272] * 5, atol=2e-4)
    np.testing.assert_allclose([first[f"irr_750_QE{k}"] for k in range(1, 6)], [100.0] * 5, rtol=1e-6)
    # two partners: first by name; no partner: NULL; shutter failure: all NULL but kept
    np.testing.assert_allclose([first[f"irr_750_HR{k}"] for k in range(1, 6)], [50.0] * 5, rtol=1e-6)
    assert out[rf.name(minutes(15), "QE_PRO_")].irr_750_HR1 is None
    stuck = out[rf.name(minutes(30), "QE_PRO_")]
    assert stuck.status == "shutter" and all(stuck[c] is None for c in COLUMNS)


def test_diurnal_by_position(product):
    out = {r.file_name: r for r in diurnal(*product, QE, HR, pairing="position").collect()}
    want = {0: 50.0, 15: 60.0, 90: None, 105: None}
    for n, level in want.items():
        got = out[rf.name(minutes(n), "QE_PRO_")].irr_750_HR1
        assert got == (pytest.approx(level, rel=1e-6) if level else None)
    with pytest.raises(ValueError):
        diurnal(*product, QE, HR, pairing="nearest")


def test_partner_of_the_second_set_up_reads_irradiance(spark, vectors):
    """Irradiance columns follow the channel, not the row parity."""
    text = rf.hr_file(T0, level=5.0, t=(600_000, 400_000))
    files = spark.createDataFrame([(rf.name(T0, "HR2000PLUS_"), text)], "file_name string, value string")
    from verdance.operators.level1 import reference_values

    obs = attach_calibration(raw.parse(files), vectors)
    normal = reference_values(obs, HR, "v").first()
    swapped = reference_values(obs, HR_RAD_FIRST, "v").first()
    assert normal.v1 == pytest.approx(5.0, rel=1e-6)
    assert swapped.v1 != pytest.approx(5.0, rel=1e-3)


def test_products_on_disk(spark, parsed, product, tmp_path):
    sinks.write_observations(parsed, str(tmp_path / "obs"))
    back = spark.read.parquet(str(tmp_path / "obs"))
    assert back.count() == 12 and back.where("parse_ok = false").count() == 3
    table = diurnal(*product, QE, HR).cache()
    path = sinks.write_diurnal_csv(table, str(tmp_path))
    assert path.endswith("/189sif.csv")
    csv = spark.read.csv(path, header=True, nullValue="NA", inferSchema=True)
    assert csv.columns == ["row", *COLUMNS] and csv.count() == 5
    assert csv.where("date IS NULL").count() == 1
    sinks.write_diurnal_table(table.selectExpr("*", "2016 AS year"), str(tmp_path / "t"), "year")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


@pytest.mark.parametrize(
    "text, want",
    [
        ("Jul_08_16_00_40_2016", T0),
        ("Jul  8 16:00:40 2016", T0),
        ("Feb_30_16_00_40_2016", None),
        ("Jux_08_16_00_40_2016", None),
        ("ulA_08_16_00_40_2016", None),
        ("", None),
        (None, None),
        ("Jul_08_25_00_40_2016", None),
    ],
)
def test_clock(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.selectExpr(f"{K.parse_clock('t')} AS ts").first().ts == want


def test_times_do_not_depend_on_the_session_zone(spark):
    """02:30 does not exist on this day in New York; instruments do not care."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("QE_PRO_Mar_13_02_37_00_2016.csv",)], "n string")
        ts = K.parse_name_time("n")
        row = df.selectExpr(f"string({ts}) AS t", f"string({K.quarter_hour(ts)}) AS q", f"{K.day_key(ts)} AS d").first()
        assert (row.t, row.q) == ("2016-03-13 02:37:00", "2016-03-13 02:30:00")
        assert row.d == pytest.approx(72 + 2.5 / 24)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
