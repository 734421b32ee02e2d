"""The quality model against plain formulas: cells, ratios, the machine's optimum, the curve."""

import numpy as np
import pytest

from millrace.llm import quality


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(2)
    ratio = np.zeros(quality.CELLS)
    ratio[:60] = rng.normal(size=60)
    rows, signs = [], []
    for i in range(120):
        at = np.flatnonzero(rng.random(60) < 0.3).astype(np.int32)
        rows.append((at, 1 / max(np.sqrt((ratio[at] ** 2).sum()), 1e-12)))
        signs.append(1.0 if ratio[at].sum() + rng.normal() > 0 else -1.0)
    rows.append((np.zeros(0, np.int32), 1e12))
    signs.append(1.0)
    return ratio, rows, np.array(signs)


def test_descent_reaches_the_optimum(made):
    ratio, rows, signs = made
    share, bias = quality.descend(rows, signs, ratio, passes=2000)
    x = np.zeros((len(rows), 60))
    for i, (at, scale) in enumerate(rows):
        x[i, at] = ratio[at] * scale if len(at) else 0
    weights = np.divide(share[:60], ratio[:60])
    assert not share[60:].any()
    # Margins from shares are those of plain weights.
    margins = np.array([share[at].sum() * scale + bias if len(at) else bias for at, scale in rows])
    assert np.allclose(margins, x @ weights + bias)

    def loss(w, b):
        return (w @ w + b * b) / 2 + quality.COST * np.maximum(0, 1 - signs * (x @ w + b)).sum()

    least, rng = loss(weights, bias), np.random.default_rng(0)
    for step in (1e-1, 1e-2, 1e-3):
        for _ in range(300):
            assert loss(weights + step * rng.normal(size=60), bias + step * rng.normal()) > least - 1e-3


def test_scores_are_those_of_the_formula(made):
    ratio, rows, signs = made
    text = "To be or not to be, not to be\nagain again again é"
    at = quality.cells(text)
    assert (np.diff(at) > 0).all()
    data = text.encode()
    want = set()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            code = 0
            for byte in data[i : i + n]:
                code = (code * 0x01000193 + byte) % 2**32
            want.add(((code + n) * 0x9E3779B1 % 2**32) >> (32 - quality.BITS))
    words = text.lower().split()
    same = [int(a == b) for a, b in zip(words, words[1:], strict=False)]
    for n in range(2, 9):
        for i in range(len(same) - n + 1):
            code = int("".join(map(str, same[i : i + n])), 2)
            want.add(((code + (n << 16)) * 0x85EBCA6B % 2**32) >> (32 - quality.BITS))
    assert set(at.tolist()) == want
    rng = np.random.default_rng(1)
    ratio, share = rng.normal(size=quality.CELLS), rng.normal(size=quality.CELLS)
    model = quality.Model(ratio, share, 0.25, 2.0, -0.5)
    margin = share[at].sum() / np.sqrt((ratio[at] ** 2).sum()) + 0.25
    assert abs(model.score(text) - 1 / (1 + np.exp(-(2.0 * margin - 0.5)))) < 1e-5
    assert model.score("") == model.score(None) == pytest.approx(1 / (1 + np.exp(-(2.0 * 0.25 - 0.5))))


def test_ratios_and_sample(spark):
    rows = [(i, "good words" if i % 3 else "bad ones", int(i % 3 > 0)) for i in range(60)] + [(1, "good words", 1)] * 500 + [(5, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    counted = {r["cell"]: (r["good"], r["bad"]) for r in quality._counts(df).collect()}
    good, bad = set(quality.cells("good words")), set(quality.cells("bad ones"))
    assert counted == {c: (540 if c in good else 0, 20 if c in bad else 0) for c in good | bad}
    # A repeated id is one row of the sample.
    kept, labels = quality._sampled(df, np.ones(quality.CELLS), 15)
    assert len(kept) == 30 and sorted(labels) == [0] * 15 + [1] * 15
    few, labels = quality._sampled(df, np.ones(quality.CELLS), 1000)
    assert len(few) == 60


def test_curve_is_the_likeliest():
    rng = np.random.default_rng(3)
    margins = rng.normal(size=400)
    truth = (rng.random(400) < 1 / (1 + np.exp(-(3 * margins - 1)))).astype(float)
    weight = np.ones(400)
    slope, shift = quality.calibrate(margins, truth, weight)
    good, bad = truth.sum(), (1 - truth).sum()
    target = np.where(truth > 0, (good + 1) / (good + 2), 1 / (bad + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()

    least = loss(slope, shift)
    assert all(loss(slope + da, shift + db) >= least - 1e-9 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
    assert 1.5 < slope < 4.5
