"""The quality classifier's fit against the least risk that Newton's method finds, and its scores against plain arithmetic."""

from __future__ import annotations

import numpy as np
import pytest

from chronogrid.llm import quality

L2 = 3e-2


def rows(rng, positives, unlabelled, share):
    good = lambda n: rng.normal([1.0, 0.5, 0.0], 1.0, (n, 3))
    bad = lambda n: rng.normal([-1.0, 0.0, 0.3], 1.2, (n, 3))
    n = int(unlabelled * share)
    return good(positives), np.vstack([good(n), bad(unlabelled - n)])


def risk(w, p, u, prior):
    """pi R_P(+) + R_U(-) - pi R_P(-) of logistic loss, with the weights' squares; its parts are sums over rows."""
    loss = lambda m: np.logaddexp(0, m)  # noqa: E731  of calling a margin negative
    rest = np.mean([loss(x @ w) for x in u]) - prior * np.mean([loss(x @ w) for x in p])
    return prior * np.mean([loss(-(x @ w)) for x in p]) + rest + L2 / 2 * (w[:-1] ** 2).sum(), rest


def newton(p, u, prior):
    w, keep = np.zeros(p.shape[1]), np.r_[np.ones(p.shape[1] - 1), 0]
    for _ in range(60):
        s = 1 / (1 + np.exp(-u @ w))
        gradient = -prior * p.mean(axis=0) + u.T @ s / len(u) + L2 * w * keep
        w = w - np.linalg.solve((u * (s * (1 - s))[:, None]).T @ u / len(u) + np.diag(L2 * keep) + 1e-9 * np.eye(len(w)), gradient)
    return w


@pytest.mark.parametrize("prior", [0.3, 0.6])
def test_the_fit_has_the_least_risk(prior):
    positive, unlabelled = rows(np.random.default_rng(4), 300, 900, prior)
    model = quality.Model(unlabelled.mean(axis=0), unlabelled.std(axis=0), np.zeros(6), 0.0, 0.5)
    model = quality.fit_pu(positive, unlabelled, model, lambda _: prior, L2)
    p, u = (np.hstack([model.expand(x), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    best = newton(p, u, prior)
    least, rest = risk(best, p, u, prior)
    found, _ = risk(np.r_[model.weights, model.bias], p, u, prior)
    assert rest > 0 and least - 1e-9 <= found <= least + 2e-3
    mine, other = model.score(unlabelled), 1 / (1 + np.exp(-u @ best))
    assert np.abs(mine - other).max() < 0.06


def test_overfitted_rows_stay_on_the_positive_side():
    """With a prior far too high the part that can't be negative would be; the fit stops there."""
    positive, unlabelled = rows(np.random.default_rng(5), 60, 60, 0.2)
    model = quality.fit_pu(positive, unlabelled, quality.Model(np.zeros(3), np.ones(3), np.zeros(6), 0.0, 0.5), lambda _: 0.95, 0.0)
    p, u = (np.hstack([model.expand(x), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    assert risk(np.r_[model.weights, model.bias], p, u, 0.95)[1] > -0.05


def test_scores_are_the_models(spark):
    rng = np.random.default_rng(6)
    texts = ["", None, "A plain line of words.\nAnd one more of them.", "!!! $$$ ### " * 30, "word " * 200]
    model = quality.Model(rng.normal(size=quality.WIDTH), rng.uniform(0.5, 2, quality.WIDTH), rng.normal(size=2 * quality.WIDTH) / 20, 0.1, 0.5)
    seen = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", quality.feature_column("text").alias("x"))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality._scored(seen, "x", model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        margin = model.bias
        for k, v in enumerate(quality.features(text)):
            z = min(6.0, max(-6.0, (v - model.mean[k]) / model.scale[k]))
            margin += z * model.weights[k] + abs(z) * model.weights[quality.WIDTH + k]
        score = 1 / (1 + np.exp(-margin))
        assert abs(got[i][0] - score) < 1e-9 and got[i][1] == (got[i][0] >= 0.5)
    assert got[0] == got[1]
