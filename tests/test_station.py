"""Stations in the product, files that arrive late, and files with many pairs."""

import datetime as dt

import pytest
import rawfiles as rf

from verdance.operators import level1 as L
from verdance.plans.diurnal import diurnal, diurnal_long, refresh
from verdance.profiles import HR, QE
from verdance.sources import calibration as C
from verdance.sources import raw

T0 = dt.datetime(2016, 7, 18, 16, 0, 40)
DAY = dt.timedelta(days=1)
MIN = dt.timedelta(minutes=1)


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [
        (p.name, c, k + 1, float(v))
        for p in (QE, HR)
        for c, values in zip(("irr", "rad"), rf.coefs(p), strict=True)
        for k, v in enumerate(values)
    ]
    return C.vectors(spark.createDataFrame(rows, "instrument string, channel string, pixel int, coef double")).cache()


def parsed(spark, files, vectors):
    """``files``: (station, batch, name, text)."""
    df = spark.createDataFrame(files, "station string, batch int, file_name string, value string")
    obs = raw.good(raw.parse(df, keep=("station", "batch")))
    obs = obs.selectExpr("concat_ws('/', station, file_name) AS file_id", "*").repartition(2)
    return L.attach_calibration(obs, vectors)


def build(obs):
    return diurnal(obs.where("instrument = 'QE'"), obs.where("instrument = 'HR'"), QE, HR, by=["station"])


def files():
    out = []
    for station in ("s1", "s2"):
        for d in range(3):
            ts = T0 + d * DAY
            out.append((station, 1, rf.name(ts, "QE_PRO_"), rf.qe_file(ts)))
            # the partner of the second day at s1 comes a day late
            late = station == "s1" and d == 1
            if station == "s1" or d == 2:
                out.append((station, 2 if late else 1, rf.name(ts + MIN, "HR2000PLUS_"), rf.hr_file(ts + MIN)))
    return out


def test_partners_meet_at_their_station_only(spark, vectors):
    rows = {r.file_id: r for r in build(parsed(spark, files(), vectors)).collect()}
    assert len(rows) == 6
    partnered = {(r.station, r.date // 1) for r in rows.values() if r.irr_750_HR1 is not None}
    doy = T0.timetuple().tm_yday - 1
    assert partnered == {("s1", doy), ("s1", doy + 1), ("s1", doy + 2), ("s2", doy + 2)}
    assert {r.n_pairs for r in rows.values()} == {5}
    assert {r.status for r in rows.values()} == {"ok"}


def test_a_late_partner_changes_its_day_only(spark, vectors, tmp_path):
    obs = parsed(spark, files(), vectors).cache()
    path = str(tmp_path / "diurnal")
    refresh(obs.where("batch = 1"), "batch = 1", path, build)
    folders = sorted(p for p in (tmp_path / "diurnal").glob("station=*/day=*"))
    assert len(folders) == 6
    before = {p: sorted(f.name for f in p.glob("*.parquet")) for p in folders}

    def seen():
        return sorted(map(str, spark.read.parquet(path).drop("day").select(*build(obs).columns).collect()))

    assert seen() != sorted(map(str, build(obs).collect()))
    for _ in range(2):  # again after a failure: the same
        refresh(obs, "batch = 2", path, build)
        assert seen() == sorted(map(str, build(obs).collect()))
    changed = [p for p in folders if sorted(f.name for f in p.glob("*.parquet")) != before[p]]
    assert [p.parent.name + "/" + p.name for p in changed] == [f"station=s1/day={(T0 + DAY).date()}"]


def test_a_file_of_seven_pairs_loses_nothing(spark, vectors):
    lines = rf.qe_file(T0).rstrip("\n").split("\n")
    text = "\n".join([*lines, *lines[-4:]]) + "\n"
    obs = parsed(spark, [("s1", 1, rf.name(T0, "QE_PRO_"), text)], vectors)
    flux = {r.pair_no: r.value for r in L.reference_flux(obs, QE, ["file_id"]).collect()}
    assert sorted(flux) == [1, 2, 3, 4, 5, 6, 7] and None not in flux.values()
    long = diurnal_long(obs, QE, ["station"]).collect()
    assert sorted(r.pair_no for r in long) == [1, 2, 3, 4, 5, 6, 7]
    assert {(r.station, r.status) for r in long} == {("s1", "ok")}
    wide = build(obs).first()
    assert wide.n_pairs == 7
    assert [wide[f"irr_750_QE{k}"] for k in range(1, 6)] == pytest.approx([flux[k] for k in range(1, 6)])


def test_a_file_without_calibration_in_force(spark, vectors):
    versions = vectors.selectExpr("*", "timestamp_ntz'2016-07-19 00:00:00' AS valid_from")
    obs = parsed(spark, files(), vectors).drop("coef_irr", "coef_rad")
    dated = C.attach_in_force(obs, versions)
    out = {r.file_id: r.status for r in build(dated).collect()}
    first = rf.name(T0, "QE_PRO_")
    assert {k for k, s in out.items() if s == "no_calibration"} == {f"s1/{first}", f"s2/{first}"}
    assert set(out.values()) == {"ok", "no_calibration"}
    long = diurnal_long(dated.where("instrument = 'QE'"), QE).where("status = 'no_calibration'").collect()
    assert len(long) == 10 and all(r.sif is None for r in long)
