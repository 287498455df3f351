import numpy as np
import pytest

from codestrata.llm import vptree


def frame_of(spark, x, ids, order=None):
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    return spark.createDataFrame([rows[k] for k in order] if order is not None else rows, "vec_id bigint, embedding array<double>")


def brute(x, ids, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = set()
    for i in range(len(ids)):
        best = sorted((d[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out |= {(int(ids[i]), r + 1, int(n), round(float(v), 6)) for r, (v, n) in enumerate(best)}
    return out


def found(frame, **options):
    return {tuple(r) for r in vptree.neighbors(frame, **options).collect()}


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 120)
    monkeypatch.setattr(vptree, "QUERY_ROWS", 50)
    monkeypatch.setattr(vptree, "LEAF", 8)


def test_ties_are_ranked_by_id_in_any_order_of_rows(spark, small_shards):
    rng = np.random.default_rng(3)
    same = np.tile([[1.5, -2.0, 0.25]], (300, 1))
    ids = np.arange(300) * 7 % 1000
    assert found(frame_of(spark, same, ids), k=3) == brute(same, ids, 3)
    grid = rng.integers(0, 4, (350, 3)).astype(float)
    ids = rng.permutation(350)
    want = brute(grid, ids, 4)
    assert found(frame_of(spark, grid, ids), k=4) == want
    assert found(frame_of(spark, grid, ids, rng.permutation(350)), k=4) == want


@pytest.mark.parametrize("offset,spread", [(1e4, 1e-4), (0.0, 1e18), (0.0, 1e-15), (1e15, 1.0), (0.0, 1e100)])
def test_vectors_of_any_size_and_place(spark, small_shards, offset, spread):
    rng = np.random.default_rng(5)
    x = offset + spread * rng.normal(size=(260, 6))
    x[::9] = x[0]
    got = {(a, r, b) for a, r, b, _ in found(frame_of(spark, x, np.arange(260)), k=5)}
    assert got == {(a, r, b) for a, r, b, _ in brute(x, np.arange(260), 5)}


def test_a_larger_factor_only_loses_what_it_may(spark, small_shards):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16)) + 6 * rng.integers(0, 4, (400, 1))
    want = {(a, b) for a, _, b, _ in brute(x, np.arange(400), 5)}
    got = {(a, b) for a, _, b, _ in found(frame_of(spark, x, np.arange(400)), k=5, factor=1.3)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
