"""Level 1 against plain NumPy on random files, for every kind of set-up."""

import numpy as np
import pytest

from verdance.operators import level1 as L
from verdance.operators.offsets import pooled_offsets, readded, spectrum_offsets
from verdance.profiles import BARE_FIBRE, COSINE_CORRECTOR, QE

P = 40
BASE = QE.variant(pixels=P, black=((1, 3), (38, 40)), window=(8, 30), reference_pixel=20, band_nm=0.3)
SETUPS = {
    "centred": BASE,
    "plain": BASE.variant(dark="plain"),
    "black": BASE.variant(dark="black", black=((1, 5),)),
    "rad_irr": BASE.variant(channel_order="rad_irr", dark="plain"),
    "rad_irr_centred": BASE.variant(channel_order="rad_irr"),
}
NL = [0.9, 1e-5, -2e-10, 1e-15, 0.0, 1e-26, 0.0, -1e-36]
T = (1_234_567, 765_432)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return {
        f"f{k}": {
            "spectra": rng.uniform(5_000, 60_000, (2 * pairs, P)),
            "dark1": rng.uniform(900, 1100, P),
            "dark2": rng.uniform(1000, 1200, P),
        }
        for k, pairs in enumerate((5, 5, 3))
    }


@pytest.fixture(scope="module")
def vectors():
    p = np.arange(1, P + 1)
    return {"coef_irr": 2e-5 + 1e-7 * p, "coef_rad": 1.5e-8 + 1e-10 * p, "band_nm": 0.3 + 0.001 * p}


@pytest.fixture(scope="module")
def obs(spark, data, vectors):
    rows = [
        (k, d["spectra"].tolist(), d["dark1"].tolist(), d["dark2"].tolist(), *T, NL,
         *[v.tolist() for v in vectors.values()])
        for k, d in data.items()
    ]
    arr = "array<double>"
    return spark.createDataFrame(
        rows,
        f"file_id string, spectra array<{arr}>, dark1 {arr}, dark2 {arr}, inte_t1_us long, inte_t2_us long,"
        f" nl_coeff {arr}, coef_irr {arr}, coef_rad {arr}, band_nm {arr}",
    ).cache()


def brute(d, profile, vectors, per_pixel):
    """corrected, linear and flux matrices of one file; flux is NaN at black pixels."""
    black = np.concatenate([np.arange(lo - 1, hi) for lo, hi in profile.black])
    s = d["spectra"]
    corrected = np.empty_like(s)
    flux = np.empty_like(s)
    for row in range(len(s)):
        first = row % 2 == 0
        dark = d["dark1"] if first else d["dark2"]
        offset = s[row % 2 :: 2][:, black].mean()
        if profile.dark == "centred":
            corrected[row] = s[row] - (dark - dark[black].mean()) - offset
        elif profile.dark == "plain":
            corrected[row] = s[row] - dark
        else:
            corrected[row] = s[row] - offset
    linear = corrected / sum(c * corrected**i for i, c in enumerate(NL))
    for row in range(len(s)):
        is_irr = (row % 2 == 0) == (profile.channel_order == "irr_rad")
        optic = COSINE_CORRECTOR if is_irr else BARE_FIBRE
        coef = vectors["coef_irr" if is_irr else "coef_rad"]
        band = vectors["band_nm"] if per_pixel else profile.band_nm
        flux[row] = coef / optic.solid_angle_sr / (T[row % 2] / 1e6) / optic.area_m2 / band / 1e3 * linear[row]
    flux[:, black] = np.nan
    return corrected, linear, flux


@pytest.mark.parametrize("per_pixel", [False, True])
@pytest.mark.parametrize("name", list(SETUPS))
def test_against_numpy(obs, data, vectors, name, per_pixel):
    profile = SETUPS[name]
    src = obs if per_pixel else obs.drop("band_nm")
    want = {k: brute(d, profile, vectors, per_pixel) for k, d in data.items()}
    px = L.spectrum_pixels(src, profile, ["file_id"]).toPandas()
    assert len(px) == sum(m[0].size for m in want.values())
    for col, i in (("corrected", 0), ("linear", 1), ("flux", 2)):
        ref = np.array([want[f][i][r - 1, p - 1] for f, r, p in zip(px.file_id, px.row_no, px.pixel)])
        np.testing.assert_allclose(px[col].astype(float), ref, rtol=1e-10)

    first = profile.irr_parity - 1
    table = L.flux_table(src, profile, ["file_id"]).toPandas()
    assert len(table) == 13
    for t in table.itertuples():
        flux = want[t.file_id][2]
        irr, rad = flux[2 * (t.pair_no - 1) + first], flux[2 * (t.pair_no - 1) + 1 - first]
        np.testing.assert_allclose(np.array(t.irr, float), irr, rtol=1e-10)
        np.testing.assert_allclose(np.array(t.rad, float), rad, rtol=1e-10)
        np.testing.assert_allclose(np.array(t.reflectance, float), rad / irr, rtol=1e-10)

    cut = L.pair_pixels(src, profile, ["file_id"], 2, 12).toPandas()
    assert sorted(cut.pixel.unique()) == list(range(2, 13))
    for c in cut.itertuples():
        flux = want[c.file_id][2]
        row = 2 * (c.pair_no - 1) + first
        np.testing.assert_allclose(float(c.irr if c.irr is not None else np.nan), flux[row, c.pixel - 1], rtol=1e-10)
        np.testing.assert_allclose(float(c.irr_mid), flux[row, 6], rtol=1e-10)

    refs = L.reference_values(src, profile, "v").toPandas().set_index("file_id")
    for f, (_, _, flux) in want.items():
        expect = flux[first::2, profile.reference_pixel - 1]
        got = refs.loc[f, [f"v{k}" for k in range(1, 6)]].astype(float).to_numpy()
        np.testing.assert_allclose(got[: len(expect)], expect, rtol=1e-10)
        assert np.isnan(got[len(expect) :]).all()

    x = np.arange(1, profile.window_size + 1)
    fits = L.curves(L.fluorescence(src, profile, ["file_id"]), profile).toPandas()
    assert len(fits) == 13 and set(fits.status) == {"ok"}
    lo, hi = profile.window
    for t in fits.itertuples():
        flux = want[t.file_id][2]
        e = flux[2 * (t.pair_no - 1) + first, lo - 1 : hi]
        y = flux[2 * (t.pair_no - 1) + 1 - first, lo - 1 : hi]
        e, y = np.nan_to_num(e), y
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x, e, x * e]), y, rcond=None)[0]
        np.testing.assert_allclose([t.c0, t.c1, t.c2, t.c3], beta, rtol=1e-6)
        np.testing.assert_allclose(t.sif_line, beta[0] + beta[1] * x, rtol=1e-6)
        np.testing.assert_allclose(t.slope_line, beta[2] + beta[3] * x, rtol=1e-6)
        assert t.sif == pytest.approx(beta[0] + beta[1] * 18)


def test_flat_table_offsets(spark, data):
    profile = SETUPS["centred"]
    rows = [
        (f, r + 1, row.tolist(), NL) for f, d in data.items() for r, row in enumerate(d["spectra"])
    ]
    rows[0][2][0] = None
    df = spark.createDataFrame(rows, "file_id string, row_no int, counts array<double>, nl_coeff array<double>")
    black = [0, 1, 2, 37, 38, 39]
    pooled = {(r.file_id, r.channel): r.offset for r in pooled_offsets(df, profile).collect()}
    assert pooled["f0", "irr"] is None
    assert pooled["f0", "rad"] == pytest.approx(data["f0"]["spectra"][1::2][:, black].mean())
    single = {(r.file_id, r.row_no): r.offset for r in spectrum_offsets(df, profile).collect()}
    assert single["f0", 1] is None
    own = data["f1"]["spectra"][3, black].mean()
    assert single["f1", 4] == pytest.approx(own)
    s = data["f1"]["spectra"][3] - own
    want = s / sum(c * s**i for i, c in enumerate(NL)) + own
    got = readded(df, profile).where("file_id = 'f1' AND row_no = 4").orderBy("pixel").toPandas()
    np.testing.assert_allclose(got.value, want, rtol=1e-10)


def test_identity_response_changes_nothing(obs, data):
    plain = obs.selectExpr(
        *[c for c in obs.columns if c != "nl_coeff"], "array(1D, 0D, 0D, 0D, 0D, 0D, 0D, 0D) AS nl_coeff"
    )
    px = L.spectrum_pixels(plain, BASE, ["file_id"]).toPandas()
    np.testing.assert_array_equal(px.corrected, px.linear)


def test_incomplete_file_has_no_pairs(spark, obs):
    one = obs.limit(1).selectExpr(*[c for c in obs.columns if c != "spectra"], "slice(spectra, 1, 1) AS spectra")
    assert L.flux_table(one, BASE, ["file_id"]).count() == 0
    assert [r.status for r in L.fluorescence(one, BASE, ["file_id"]).collect()] == ["missing"]
