"""The ranking is learnt from all labelled documents: pairs, weights and thresholds against brute force."""

import numpy as np
import pytest

from rasterflow.llm import preference_ranking as P


def rows_frame(spark, x, y, slices=5):
    rows = [(i, int(q), v.tolist()) for i, (q, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, quality int, x array<double>").repartition(slices)


def sample(n, share, seed=3):
    r = np.random.default_rng(seed)
    y = (r.random(n) < share).astype(int)
    return r.normal(size=(n, len(P.FEATURES))) + 0.5 * y[:, None], y


def test_every_labelled_document_counts(spark):
    """One document of many more than the fit took before has a feature's only value: its weight and mean tell of it."""
    n = 30_000
    ids = np.arange(n)
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id % 7, ' some words here, and ', id % 5) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    rows = P.learn(docs, labels)
    kept = [i for i in ids if P.fold(int(i)) != 0]
    x = np.array([P.features(f"w{i % 7} some words here, and {i % 5}") for i in kept])
    assert len(kept) > 20_000
    assert np.allclose(rows.mean, x.mean(0), rtol=1e-9, atol=1e-12) and np.allclose(rows.scale, np.maximum(x.std(0), 1e-6), rtol=1e-5, atol=2e-6)


@pytest.mark.parametrize("share", [0.5, 0.93, 0.004])
def test_blocks_hold_every_row(spark, share):
    x, y = sample(3000, share)
    few = 1 if y.sum() * 2 <= len(y) else 0
    n_few = int((y == few).sum())
    d = len(P.FEATURES)
    blocks = P._blocks(rows_frame(spark, x, y), few, n_few, len(y) - n_few, np.zeros(d), np.ones(d)).collect()
    seen = {0: [], 1: []}
    for b in blocks:
        z = np.frombuffer(b.z).reshape(-1, d)
        assert 0 < b.good < len(z)
        seen[1] += z[: b.good].tolist()
        seen[0] += z[b.good :].tolist()
    want = np.clip(x, -6, 6)
    for kind in (0, 1):
        assert set(map(tuple, seen[kind])) == set(map(tuple, want[y == kind].tolist()))
    assert len(seen[1 - few]) == (y != few).sum()


def test_weights_are_the_least_loss(spark):
    x, y = sample(400, 0.5)
    d = len(P.FEATURES)
    blocks = P._blocks(rows_frame(spark, x, y), int(y.sum() * 2 <= len(y)), int(min(y.sum(), len(y) - y.sum())), int(max(y.sum(), len(y) - y.sum())), np.zeros(d), np.ones(d))
    w = P._least_loss(blocks, 1e-3)
    diff = np.concatenate([(a[: b.good, None] - a[None, b.good :]).reshape(-1, d) for b in blocks.collect() for a in [np.frombuffer(b.z).reshape(-1, d)]])
    grad = -(diff / (1 + np.exp(diff @ w))[:, None]).mean(0) + 1e-3 * w
    assert np.abs(grad).max() < 1e-8


def test_ranks_without_listing_all(spark):
    r = np.random.default_rng(5)
    values = np.concatenate([r.normal(size=4000), np.full(3000, 0.25), r.normal(size=10) * 1e9])
    df = spark.createDataFrame([(float(v),) for v in values], "s double")
    ranks = [0, 1, 1999, 3500, 4500, len(values) - 1]
    got, want = P.at_ranks(df, len(values), ranks, listed=50), np.sort(values)
    assert got == {k: want[k] for k in ranks}
    for share in (0.01, 0.37, 1.0):
        assert P.quantile(df, len(values), share) == pytest.approx(np.quantile(values, share), rel=1e-12)


def test_same_model_again(spark):
    x, y = sample(500, 0.3)
    assert P.fit(rows_frame(spark, x, y)) == P.fit(rows_frame(spark, x, y, 3))
