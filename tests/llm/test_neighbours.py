import numpy as np
import pytest

from mastwire.llm import neighbours
from mastwire.llm.store import table


def brute(ids, vectors, k, every):
    out = {}
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    for i in np.flatnonzero(ids % every == 0):
        score = (vectors[i] * vectors).sum(axis=1)
        near = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in near]
    return out


def test_hadamard_keeps_lengths_and_axes_are_the_nearest():
    x = np.random.default_rng(0).normal(size=(50, 16))
    y = neighbours.turned(x, 3)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(x @ x.T, y @ y.T)
    both = np.concatenate((y, -y), axis=1)
    best = both.argmax(axis=1)
    assert (neighbours.axes(y, 1)[:, 0] == np.where(best < 16, 2 * best, 2 * (best - 16) + 1)).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    given = table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = given.toPandas()
    want = brute(rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), dtype=float), 20, 20)
    got = neighbours.nearest(given).toPandas()
    assert set(got.query_id) == set(want)
    hit = 0
    for q, part in got.sort_values("rank").groupby("query_id"):
        assert part["rank"].tolist() == list(range(1, 21))
        assert part.score.is_monotonic_decreasing and q not in set(part.vec_id)
        hit += len(set(part.vec_id) & {v for v, _ in want[q]})
        true = dict(want[q])
        assert all(abs(true[v] - s) < 1e-12 for v, s in zip(part.vec_id, part.score, strict=True) if v in true)
    assert hit / (20 * len(want)) >= 0.93


def test_copies_ties_and_unusable_rows_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rng = np.random.default_rng(1)
    base = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [-1.0, 0.0, 0.0], [3.0, 4.0, 0.0]]
    rows = [(i, base[int(rng.integers(5))] if i % 3 else base[0], "x") for i in range(90)]
    rows += [(100, None, "x"), (120, [0.0, 0.0, 0.0], "x"), (140, [1.0, None, 0.0], "x"), (160, [float("nan"), 1.0, 0.0], "x"),
             (180, [1.0, 2.0], "x"), (None, base[0], "x"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string")
    ids, vectors = np.arange(90), np.array([r[1] for r in rows[:90]])
    want = brute(ids, vectors, 20, 20)
    got = {}
    for r in neighbours.nearest(docs, tables=2, probes=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q in want:  # equal vectors share a bucket, and short lists are filled from all
        assert len(got[q]) == 20 and got[q][0] == want[q][0]
    exact = neighbours.nearest(docs, tables=4, probes=8).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in exact] == [(q, v, s) for q in sorted(want) for v, s in want[q]]


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in neighbours.nearest(few).orderBy("query_id", "rank").collect()] == [
        (0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert neighbours.nearest(few.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("norms", ["log-normal", "one long"])
def test_recall_with_uneven_norms(spark, norms):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(0.7 * rng.normal(size=(6000, 1))) if norms == "log-normal" else np.where(np.arange(6000) == 7, 5.0, 1.0)[:, None]
    want = brute(np.arange(6000), x, 20, 20)
    got = neighbours.nearest(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).toPandas()
    hit = sum(len(set(part.vec_id) & {v for v, _ in want[q]}) for q, part in got.groupby("query_id"))
    assert hit / (20 * len(want)) >= 0.93
