import numpy as np
import pytest

from verdance.functions.lsq import fit_groups
from verdance.operators.level1 import fluorescence
from verdance.profiles import QE

N = 89
X = np.arange(1, N + 1)


def design(e):
    return np.column_stack([np.ones(N), X, e, X * e])


def test_groups_against_numpy(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for g in range(30):
        e = 150 + 60 * np.cos(X / 9) + rng.normal(size=N)
        y = 1.2 + 0.004 * X + (0.35 + 0.0005 * X) * e + rng.normal(size=N) * 0.1
        beta = np.linalg.lstsq(design(e), y, rcond=None)[0]
        rsq = np.corrcoef(design(e) @ beta, y)[0, 1] ** 2
        want[g] = [*beta, rsq]
        rows += [(g, int(a), float(b), float(c), float(e[44]), float(y[44])) for a, b, c in zip(X, e, y)]
    df = spark.createDataFrame(rows, "g int, x int, e double, y double, e0 double, y0 double")
    for shift in ({}, {"e_shift": "e0", "y_shift": "y0"}):
        for row in fit_groups(df, ["g"], "y", "x", "e", **shift).collect():
            got = [row.c0, row.c1, row.c2, row.c3, row.rsq]
            assert row.n == N
            np.testing.assert_allclose(got, want[row.g], rtol=1e-6)


def test_hot_group_and_missing_values(spark):
    """A third of all rows in one group; rows with a missing value take no part."""
    df = spark.range(0, 90_000, 1, 8).selectExpr(
        "if(id % 3 = 0, 0, id % 500 + 1) AS g",
        "double(id % 17) AS x",
        "double(pmod(hash(id), 101)) AS e",
        "id",
    )
    df = df.selectExpr("g", "x", "if(id % 11 = 0, NULL, e) AS e", "2 + 3 * x - 0.5D * e + 0.25D * x * e AS y")
    out = {r.g: r for r in fit_groups(df, ["g"], "y", "x", "e").collect()}
    assert len(out) == 501
    hot = out[0]
    np.testing.assert_allclose([hot.c0, hot.c1, hot.c2, hot.c3, hot.rsq], [2, 3, -0.5, 0.25, 1], rtol=1e-8)
    assert hot.n == df.where("g = 0 AND e IS NOT NULL").count()


def test_predictor_far_from_zero(spark):
    """Exact data keep their slope and never get more than a perfect fit."""
    rng = np.random.default_rng(1)
    for mean in (1e4, 1e5, 1e6, 1e7):
        x, e = rng.normal(size=200), rng.normal(size=200) + mean
        rows = [("g", float(a), float(b), float(2 + 0.5 * a + 0.05 * (b - mean) + 0.01 * a * (b - mean))) for a, b in zip(x, e)]
        got = fit_groups(spark.createDataFrame(rows, "g string, x double, e double, y double"), ["g"], "y", "x", "e").first()
        np.testing.assert_allclose([got.c2, got.c3, got.rsq], [0.05, 0.01, 1.0], rtol=1e-6)
        assert got.rsq < 1 + 1e-9


def test_constant_predictor_and_constant_response(spark):
    rows = [(0, float(x), 5.0, float(x)) for x in range(10)]
    rows += [(1, float(x), float(x % 3), 4.0) for x in range(10)]
    df = spark.createDataFrame(rows, "g int, x double, e double, y double")
    out = {r.g: r for r in fit_groups(df, ["g"], "y", "x", "e").collect()}
    assert out[0].c3 is None and out[0].rsq is None
    assert out[1].rsq is None


def observation(file_id, irr, rad, pixels=1044):
    """A file whose flux equals the given window values: unit factor, no dark signal."""
    first = QE.window[0] - 1

    def row(values):
        out = [1.0] * pixels
        out[first : first + N] = values
        for lo, hi in QE.black:
            out[lo - 1 : hi] = [0.0] * (hi - lo + 1)
        return out

    return (file_id, [row(irr), row(rad)])


@pytest.fixture(scope="module")
def cases(spark):
    e = (150 + 60 * np.cos(X / 9)).tolist()
    y = (1.2 + 0.004 * X + (0.35 + 0.0005 * X) * np.array(e)).tolist()
    rows = [
        observation("good", e, y),
        observation("dark_irr", [0.0] * N, y),
        observation("dark_rad", e, [0.0] * N),
        observation("gap_rad", e, [None, *y[1:]]),
        observation("gap_irr", [None, *e[1:]], y),
        observation("flat_irr", [3.0] * N, y),
        ("no_spectra", None),
        observation("scaled", [4 * v for v in e], y),
    ]
    obs = spark.createDataFrame(rows, "file_id string, spectra array<array<double>>")
    scale_irr = np.pi * 1.95 * 1.95 * np.pi * 1e-6 * 1e3 * QE.band_nm
    scale_rad = 0.153721 * 0.25 * np.pi * 1e-6 * 1e3 * QE.band_nm
    obs = obs.selectExpr(
        "*",
        "array(1D, 0D, 0D, 0D, 0D, 0D, 0D, 0D) AS nl_coeff",
        "1000000 AS inte_t1_us",
        "1000000 AS inte_t2_us",
        "array_repeat(0D, 1044) AS dark1",
        "array_repeat(0D, 1044) AS dark2",
        f"array_repeat({scale_irr!r}D, 1044) AS coef_irr",
        f"array_repeat({scale_rad!r}D, 1044) AS coef_rad",
    )
    return {r.file_id: r for r in fluorescence(obs, QE, ["file_id"]).collect()}


def test_known_coefficients_come_back(cases):
    got = cases["good"]
    assert got.status == "ok"
    np.testing.assert_allclose(
        [got.c0, got.c1, got.c2, got.c3, got.sif, got.rsq], [1.2, 0.004, 0.35, 0.0005, 1.272, 1.0], rtol=1e-7
    )


def test_scaling_irradiance_keeps_fluorescence(cases):
    got = cases["scaled"]
    np.testing.assert_allclose([got.sif, got.c2, got.c3], [1.272, 0.35 / 4, 0.0005 / 4], rtol=1e-7)


@pytest.mark.parametrize(
    "case, status",
    [
        ("dark_irr", "no_signal"),
        ("dark_rad", "no_signal"),
        ("gap_rad", "bad_radiance"),
        ("flat_irr", "singular"),
        ("no_spectra", "missing"),
    ],
)
def test_no_fit_is_named(cases, case, status):
    got = cases[case]
    assert got.status == status
    assert got.c0 is None and got.sif is None and got.rsq is None


def test_missing_irradiance_counts_as_zero(cases):
    e = 150 + 60 * np.cos(X / 9)
    y = 1.2 + 0.004 * X + (0.35 + 0.0005 * X) * e
    e[0] = 0
    beta = np.linalg.lstsq(design(e), y, rcond=None)[0]
    got = cases["gap_irr"]
    assert got.status == "ok"
    np.testing.assert_allclose([got.c0, got.c1, got.c2, got.c3], beta, rtol=1e-6)


def test_merged_sums_are_those_of_all_rows(spark):
    """Groups with shifts of their own, some far apart, merged in one and in two steps; empty groups and null keys."""
    from verdance.functions.lsq import fit_sums, merge_sums, solve_sums

    rng = np.random.default_rng(8)
    rows = []
    for day in range(4):
        for part in range(6):
            for _ in range(40 if part else 0):
                x, e = rng.uniform(-1, 1), 150 + 30 * part * (day != 2) + rng.normal()
                y = 1.2 + 0.004 * x + (0.35 + 0.01 * x) * e + rng.normal() * 0.1
                rows.append((day if day else None, part, float(x), float(e), float(y)))
        rows.append((day if day else None, 0, 1.0, None, 2.0))
    df = spark.createDataFrame(rows, "day int, part int, x double, e double, y double")
    for own in ({}, {"e_shift": "100D + part", "y_shift": "50D"}):
        sums = fit_sums(df, ["day", "part"], "y", "x", "e", **own).cache()
        want = {r.day: r for r in fit_groups(df, ["day"], "y", "x", "e").collect()}
        halves = merge_sums(sums.selectExpr("*", "part % 2 AS half"), ["day", "half"])
        for merged in (merge_sums(sums, ["day"]), merge_sums(halves, ["day"])):
            got = {r.day: r for r in solve_sums(merged).collect()}
            assert sorted(got, key=str) == sorted(want, key=str)
            for day, r in got.items():
                assert r.n == want[day].n == 200
                np.testing.assert_allclose([r.c0, r.c1, r.c2, r.c3, r.rsq], list(want[day][2:7]), rtol=1e-9)
    whole = solve_sums(merge_sums(sums, [])).first()
    total = fit_groups(df.selectExpr("1 AS k", "*"), ["k"], "y", "x", "e").first()
    np.testing.assert_allclose([whole.c0, whole.c2, whole.rsq], [total.c0, total.c2, total.rsq], rtol=1e-9)


def test_daily_fits_of_batches(spark, tmp_path):
    """A late batch refits its day from sums; the result is the fit of all pixels of the day."""
    import datetime as dt

    from verdance.operators.level1 import pair_pixels
    from verdance.streaming.published import DailyFits

    profile = QE.variant(pixels=40, black=((1, 3), (38, 40)), window=(8, 30), reference_pixel=20, dark="black")
    rng = np.random.default_rng(5)
    day = dt.datetime(2016, 7, 18, 12)
    rows = []
    for k in range(8):
        spectra = rng.uniform(5_000, 60_000, (4, 40))
        if k == 5:
            spectra[1, 15] = np.nan
        lists = [[None if np.isnan(v) else float(v) for v in s] for s in spectra]
        rows.append((f"f{k}", day + dt.timedelta(days=k % 2), k // 3, "s" if k != 7 else "t", lists))
    obs = spark.createDataFrame(rows, "file_id string, obs_ts timestamp_ntz, batch int, station string, spectra array<array<double>>")
    obs = obs.selectExpr(
        "*", "array(1D, 0D, 0D, 0D, 0D, 0D, 0D, 0D) AS nl_coeff", "1000000L AS inte_t1_us", "2000000L AS inte_t2_us",
        "transform(sequence(1, 40), p -> 2e-5D + 1e-7D * p) AS coef_irr", "transform(sequence(1, 40), p -> 1.5e-8D) AS coef_rad",
    )
    table = DailyFits(str(tmp_path / "fits"), profile, ("station",))
    for batch in (0, 2, 1, 1):
        table.take(obs.where(f"batch = {batch}"), batch)
    got = {(str(r.day), r.station, r.pair_no): r for r in table.read(spark, obs).collect()}
    px = pair_pixels(obs, profile, ["file_id", "station", "obs_ts"], 8, 30).where("NOT (file_id = 'f5' AND pair_no = 1)")
    px = px.selectExpr("string(to_date(obs_ts)) AS day", "station", "pair_no", "(pixel - 19) / 11D AS x", "irr", "rad")
    want = {(r.day, r.station, r.pair_no): r for r in fit_groups(px, ["day", "station", "pair_no"], "rad", "x", "irr").collect()}
    assert sorted(got) == sorted(want) and len(want) == 6
    for k, r in got.items():
        assert r.status == "ok" and r.n_pairs == want[k].n // 23
        np.testing.assert_allclose([r.rsq, r.c3 * 11], [want[k].rsq, want[k].c3], rtol=1e-9)


def test_lower_bound(spark):
    from verdance.functions.arrays import lower_bound

    rows = [(k, [float(x) for x in range(0, 2 * n, 2)]) for k, n in enumerate((0, 1, 2, 3, 7, 8, 100))] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, a array<double>")
    values = [-1.0, 0.0, 1.0, 4.0, 5.0, 13.0, 14.0, 197.5, 198.0, 500.0]
    got = df.selectExpr("k", "a", *[f"{lower_bound('a', f'{v}D', 100)} AS v{i}" for i, v in enumerate(values)]).collect()
    for r in got:
        for i, v in enumerate(values):
            assert r[f"v{i}"] == (None if r.a is None else int(np.searchsorted(r.a, v)))


def test_window_by_each_file_s_axis(spark):
    """Axes shifted by whole pixels, with spectra that shift along, give one fluorescence; a nominal axis the fixed pixels."""
    rng = np.random.default_rng(2)
    nominal = QE.variant(pixels=60, black=((1, 3), (58, 60)), window=(20, 42), reference_pixel=30, dark="black")
    by_axis = nominal.variant(window_from_nm=755.0)
    axis = 755.0 + np.arange(-19, 41)  # pixel 20 is at 755
    base = rng.uniform(5_000, 60_000, (2, 90))
    rows = []
    for shift in (-5, 0, 3, 12, 30):
        # black pixels at both ends; beyond the last shift the window doesn't fit into the file
        cut = slice(20 - min(shift, 12) + 3, 20 - min(shift, 12) + 57)
        spectra = [[1000.0] * 3 + s[cut].tolist() + [1000.0] * 3 for s in base]
        rows.append((shift, [float(v) for v in axis - shift], spectra))
    df = spark.createDataFrame(rows, "file_id int, wavelength array<double>, spectra array<array<double>>").selectExpr(
        "*", "array(1D, 0D, 0D, 0D, 0D, 0D, 0D, 0D) AS nl_coeff", "1000000L AS inte_t1_us", "1000000L AS inte_t2_us",
        "transform(sequence(1, 60), p -> 1D) AS coef_irr", "transform(sequence(1, 60), p -> 1D) AS coef_rad",
    )
    got = {r.file_id: r for r in fluorescence(df, by_axis, ["file_id"]).collect()}
    fixed = {r.file_id: r for r in fluorescence(df, nominal, ["file_id"]).collect()}
    assert got[0][1:] == fixed[0][1:]
    for shift in (-5, 3, 12):
        np.testing.assert_allclose([got[shift].sif, got[shift].rsq], [got[0].sif, got[0].rsq], rtol=1e-9)
        assert abs(fixed[shift].sif - got[0].sif) > 1e-9
    assert got[30].status == "missing"
