import pytest

from verdance.functions.arrays import forward_difference, median
from verdance.profiles import DARK_MODEL_BANDS
from verdance.sources import calibration as C
from verdance.sources import sinks


def test_coefficients_in_pixel_order_from_both_key_styles(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"","x"\n' + "".join(f'"{i}",{i * 1e-5!r}\n' for i in range(1, 13)))
    (tmp_path / "b.csv").write_text('"","x","y"\n' + "".join(f'"V{i}",{i * 1e-8!r},7\n' for i in range(1, 13)))
    a = C.read_coefficients(spark, str(tmp_path / "a.csv"), "QE", "irr")
    b = C.read_coefficients(spark, str(tmp_path / "b.csv"), "QE", "rad")
    row = C.vectors(a.unionByName(b), pixels={"QE": 12}).first()
    assert row.coef_irr == [i * 1e-5 for i in range(1, 13)]
    assert row.coef_rad == [i * 1e-8 for i in range(1, 13)]


def test_vendor_lines(spark, tmp_path):
    head = "".join(f"line {i}\n" for i in range(9))
    (tmp_path / "v.cal").write_text(head + "700.1\t1.5e-5\n700.2\t2.5e-5\n")
    out = C.read_instrument_lines(spark, str(tmp_path / "v.cal"), "HR", "irr").collect()
    assert [(r.pixel, r.coef) for r in out] == [(1, 1.5e-5), (2, 2.5e-5)]


@pytest.mark.parametrize("keyed", [True, False])
def test_dark_model(spark, tmp_path, keyed):
    paths = {}
    for k, (name, _, _) in enumerate(DARK_MODEL_BANDS):
        rows = [f'"{i}",{k + i},{i * 2}' if keyed else f"{k + i},{i * 2}" for i in range(1, 12)]
        (tmp_path / f"{name}.csv").write_text(('"","V1","V2"\n' if keyed else "V1,V2\n") + "\n".join(rows) + "\n")
        paths[name] = str(tmp_path / f"{name}.csv")
    out = {r.band: r for r in C.read_dark_model(spark, paths, DARK_MODEL_BANDS, 11).collect()}
    assert sorted(out) == ["M10", "M15", "M20"]
    assert out["M15"].v1 == [1.0 + i for i in range(1, 12)] and out["M15"].v2 == [2.0 * i for i in range(1, 12)]
    assert (out["M10"].temp_lo, out["M10"].temp_hi) == (-11.0, -9.0)


def test_band_width_job(spark, tmp_path):
    axis = spark.createDataFrame([("QE", [700.0, 700.5, 701.25, 702.0])], "instrument string, wavelength array<double>")
    widths = axis.selectExpr("instrument", f"posexplode({forward_difference('wavelength')}) AS (i, nm)").selectExpr(
        "instrument", "i + 1 AS pixel", "nm"
    )
    assert [r.nm for r in widths.orderBy("pixel").collect()] == [0.5, 0.75, 0.75, 0.75]
    sinks.write_band_width(widths, str(tmp_path / "w"))
    assert [p.name for p in (tmp_path / "w").glob("*.csv")] == ["QE.csv"]
    for owner in ("QE", None):
        back = C.read_band_width(spark, str(tmp_path / "w"), owner).orderBy("pixel").collect()
        assert [(r.instrument, r.pixel, r.nm) for r in back] == [("QE", 1, 0.5), ("QE", 2, 0.75), ("QE", 3, 0.75), ("QE", 4, 0.75)]


@pytest.mark.parametrize("pixels", [[1, 2, 4], [1, 2, 2, 3], [0, 1, 2], [1, None, 3]])
def test_gaps_doubles_and_bad_keys_are_named(spark, pixels):
    rows = [("QE", c, p, 1.0) for c in ("irr", "rad") for p in pixels]
    df = spark.createDataFrame(rows, "instrument string, channel string, pixel int, coef double")
    with pytest.raises(Exception, match="bad_calibration"):
        C.vectors(df, pixels={}).collect()


def test_a_truncated_table_is_named(spark):
    """A table that ends early, or lacks a channel, fails whatever its own length says."""
    schema = "instrument string, channel string, pixel int, coef double"
    cut = [("QE", c, p, 1.0) for c in ("irr", "rad") for p in range(1, 501)]
    with pytest.raises(Exception, match="bad_calibration: pixels of irr of QE"):
        C.vectors(spark.createDataFrame(cut, schema)).collect()
    lone = spark.createDataFrame([("XX", "irr", p, 1.0) for p in range(1, 11)], schema)
    with pytest.raises(Exception, match="bad_calibration: pixels of rad of XX"):
        C.vectors(lone).collect()
    with pytest.raises(Exception, match="bad_calibration: pixels of widths of HR"):
        C.widths(spark.createDataFrame([("HR", p, 0.4) for p in range(1, 2000)], "instrument string, pixel int, nm double")).collect()


def test_gap_and_missing_number_in_a_dark_model(spark, tmp_path):
    bands = DARK_MODEL_BANDS[:1]
    path = {bands[0][0]: str(tmp_path / "m.csv")}
    (tmp_path / "m.csv").write_text('"","V1","V2"\n"1",5,1\n"2",6,1\n"4",8,1\n')
    with pytest.raises(Exception, match="bad_calibration"):
        C.read_dark_model(spark, path, bands, None).collect()
    (tmp_path / "m.csv").write_text('"","V1","V2"\n"1",5,1\n"2",NaN,1\n"3",8,NA\n')
    row = C.read_dark_model(spark, path, bands, 3).first()
    assert (row.v1, row.v2) == ([5.0, None, 8.0], [1.0, 1.0, None])
    with pytest.raises(Exception, match="bad_calibration"):
        C.read_dark_model(spark, path, bands).collect()


def test_version_in_force(spark):
    """Before the first version, at its very start, over days without rows, two versions a day, other instruments."""
    import datetime as dt

    at = lambda d, h=0, m=0: dt.datetime(2024, 3, d, h, m)
    versions = spark.createDataFrame(
        [("QE", at(5, 12)), ("QE", at(5, 15)), ("QE", at(20)), ("HR", at(1)), ("QE", at(20)), (None, at(1)), ("QE", None)],
        "instrument string, valid_from timestamp_ntz",
    )
    cases = [
        ("QE", at(5, 11, 59), None), ("QE", at(5, 12), at(5, 12)), ("QE", at(5, 14, 59), at(5, 12)), ("QE", at(5, 15), at(5, 15)),
        ("QE", at(19, 23, 59), at(5, 15)), ("QE", at(20), at(20)), ("QE", at(31), at(20)), ("HR", at(31), at(1)),
        ("XX", at(31), None), ("QE", None, None), (None, at(31), None),
    ]
    rows = spark.createDataFrame([(k, i, t) for k, (i, t, _) in enumerate(cases)], "k int, instrument string, obs_ts timestamp_ntz")
    got = {r.k: r.valid_from for r in C.in_force(rows, versions, "obs_ts").collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}
    table = versions.where("instrument IS NOT NULL AND valid_from IS NOT NULL").distinct().selectExpr("*", "array(1D) AS coef_irr")
    done = C.attach_in_force(rows, table).collect()
    assert len(done) == len(cases)
    assert all((r.calibration_status == "ok") == (r.coef_irr is not None) == (r.valid_from is not None) for r in done)


def test_versions_are_checked_one_by_one(spark):
    schema = "instrument string, valid_from timestamp_ntz, channel string, pixel int, coef double"
    import datetime as dt

    days = [dt.datetime(2024, 3, d) for d in (1, 2)]
    rows = [("XX", day, c, p, float(day.day)) for day in days for c in ("irr", "rad") for p in (1, 2)]
    got = {r.valid_from: (r.coef_irr, r.coef_rad) for r in C.vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {day: ([float(day.day)] * 2, [float(day.day)] * 2) for day in days}
    with pytest.raises(Exception, match="bad_calibration"):
        C.vectors(spark.createDataFrame(rows[:-1], schema)).collect()


def test_median(spark):
    rows = [(1, [3.0, 1.0, 2.0]), (2, [4.0, 1.0, 2.0, 3.0]), (3, [1.0, None]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id int, a array<double>")
    out = {r.id: r.m for r in df.selectExpr("id", f"{median('a')} AS m").collect()}
    assert out == {1: 2.0, 2: 2.5, 3: None, 4: None, 5: None}
