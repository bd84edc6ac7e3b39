"""Fitted models against plain versions: a forward pass by hand, slopes by differences, optima by bisection."""

import math

import numpy as np
import pandas as pd

from verdance.llm import bytenet, mixing
from verdance.llm.common import ship


def plain_score(net, text):
    """The classifier's probability, a place, a chunk and a filter at a time."""
    n_chunks = -(-(len(text) + bytenet.WIDTH - 1) // bytenet.CHUNK)
    laid = [max(b, 1) for b in text] + [0] * (n_chunks * bytenet.CHUNK + bytenet.WIDTH - 1 - len(text))
    tops = []
    for c in range(n_chunks):
        row = []
        for f in range(bytenet.FILTERS):
            places = range(c * bytenet.CHUNK, (c + 1) * bytenet.CHUNK)
            most = max(sum(float(net.table[j, laid[p + j], f]) for j in range(bytenet.WIDTH)) for p in places)
            row.append(max(most + float(net.bias[f]), 0.0))
        tops.append(row)
    peak = [max(t[f] for t in tops) for f in range(bytenet.FILTERS)]
    mean = [sum(t[f] for t in tops) / len(tops) for f in range(bytenet.FILTERS)]
    logit = sum(w * x for w, x in zip(net.weight.astype(float), peak + mean, strict=True)) + net.offset
    return 1 / (1 + math.exp(-logit))


TEXTS = [b"A short text.", b"x" * 70, "ü, ö and \x00 and more ".encode() * 9, b"!?"]


def laid(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def test_classifier_scores_as_by_hand():
    net = bytenet.Net.fresh()
    net.bias[:] = np.random.default_rng(1).normal(0, 0.3, bytenet.FILTERS)
    got = net.score(*laid(TEXTS))
    np.testing.assert_allclose(got, [plain_score(net, t) for t in TEXTS], rtol=1e-5)


def test_classifier_gradients_are_slopes_of_the_loss():
    net = bytenet.Net.fresh(7)
    y = np.array([1.0, 0.0, 1.0, 0.0])
    grads = bytenet._gradients(net, TEXTS, y)

    def loss():
        p = np.array([plain_score(net, t) for t in TEXTS])
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    r = np.random.default_rng(2)
    checked = 0
    for name, part in (("table", net.table), ("bias", net.bias), ("weight", net.weight)):
        # the marker of places outside of a text is fixed
        live = [at for at in map(tuple, np.argwhere(np.abs(grads[name]) > 1e-4)) if not (name == "table" and at[1] == 0)]
        for k in r.permutation(len(live))[:12]:
            at, step = live[k], 1e-3
            held, sides = part[at], []
            for side in (step, -step):
                part[at] = held + np.float32(side)
                sides.append(loss())
            part[at] = held
            slope = (sides[0] - sides[1]) / (2 * step)
            assert abs(slope - grads[name][at]) < 0.03 * abs(slope) + 2e-5
            checked += 1
    assert checked > 20


def test_mixing_rates_are_the_optimum(spark, sf_dir):
    """Of all rates that give a source its target, the tilted ones are nearest to one: the plain dual, by bisection."""
    ship(spark)
    out = mixing.plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    free = 0
    for _, own in out.groupby("source", dropna=False):
        size, target, total = own["size"].to_numpy(float), own.target.iloc[0], own.source_size.iloc[0]
        if not total:
            continue
        if target >= 3 * total * (1 - 1e-12):
            assert (own.rate[own["size"] > 0] == 3).all()
            continue
        z = size / ((size**2).sum() / total)
        lo, hi = -200.0, 200.0
        for _ in range(200):
            t = (lo + hi) / 2
            mixed = (size * np.minimum(3, np.exp(np.minimum(t * z, 50)))).sum()
            lo, hi = (t, hi) if mixed < target else (lo, t)
        want = np.where(size > 0, np.minimum(3, np.exp(np.minimum(t * z, 50))), 1.0)
        np.testing.assert_allclose(own.rate, want, atol=3 / mixing.ONE)
        # no feasible change of two rates lowers the distance: r log r - r has the slope log r = t z where r < 3
        inner = (want < 3 - 1e-6) & (size > 0)
        if inner.sum() > 1:
            ratio = np.log(own.rate.to_numpy()[inner]) / size[inner]
            weight = np.abs(np.log(want[inner])) > 1e-2
            if weight.sum() > 1:
                assert np.ptp(ratio[weight]) <= 1e-3 * np.abs(ratio[weight]).max()
        free += 1
    assert free > 5 and isinstance(out, pd.DataFrame)
