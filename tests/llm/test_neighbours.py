import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.llm import neighbours

KIND = "vec_id long, embedding array<double>, label int, rank int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 5, "x") for i, v in rows], KIND)


def brute(rows, every, k=10):
    ids, X = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    want = {}
    for q in np.flatnonzero(ids % every == 0):
        away = np.sqrt(((X - X[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, away)) if ids[j] != ids[q]][:k]
        want[int(ids[q])] = [(int(ids[j]), float(away[j])) for j in order]
    return want


def found(df, **more):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(want, got):
    return np.mean([len({i for i, _ in w} & {i for i, _ in got.get(q, [])}) / max(1, len(w)) for q, w in want.items()])


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_exact_scores(spark, scaled):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(3000, 20))
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    if scaled:  # norms differ by a factor of four: more cells are looked into
        X *= rng.uniform(0.5, 2, (3000, 1))
    rows = list(enumerate(X.tolist()))
    want = brute(rows, 50)
    got = found(neighbours.search(frame(spark, rows), F.col("vec_id") % 50 == 0, sample=40))
    assert set(got) == set(want) and recall(want, got) >= 0.9
    for q in got:
        true = dict(brute([(q, X[q]), *[(i, X[i]) for i, _ in got[q]]], 1, 20)[q])
        assert all(abs(true[i] - s) < 1e-12 for i, s in got[q]) and got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))


def test_cells_of_two_hashes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 8))
    rows = list(enumerate((centres[rng.integers(0, 60, 4000)] + 0.2 * rng.normal(size=(4000, 8))).tolist()))
    seen = []
    needed = neighbours.probes_needed
    monkeypatch.setattr(neighbours, "probes_needed", lambda *a: (seen.append((a[1].width, needed(*a))), seen[-1][1])[1])
    got = found(neighbours.search(frame(spark, rows), F.col("vec_id") % 40 == 0))
    assert seen[0][0] >= 2 and seen[0][1] < 256
    assert recall(brute(rows, 40), got) >= 0.9


def test_copies_ties_and_hot_cells(spark):
    """A third of all rows are one vector, another third nearly so: cells are split, ties go by id, nothing is lost."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=8)
    rows = [(i, one) for i in range(0, 1000)] + [(i, one + 1e-3 * rng.normal(size=8)) for i in range(1000, 2000)] + [(i, rng.normal(size=8)) for i in range(2000, 3000)]
    rows = [(i, v.tolist()) for i, v in rows]
    want = brute(rows, 100)
    got = found(neighbours.search(frame(spark, rows), F.col("vec_id") % 100 == 0, block_rows=256))
    assert [got[q] for q in range(0, 1000, 100)] == [want[q] for q in range(0, 1000, 100)]
    assert recall(want, got) >= 0.95


def test_odd_rows(spark):
    good = [(0, [1, 0, 0]), (1, [1, 0, 0]), (2, [0, 1, 0]), (3, [0, 0, -1]), (100, [1, 0.5, 0])]
    odd = [(4, None), (5, [0, 0, 0]), (6, [1, None, 0]), (7, [1, float("nan"), 0]), (8, [float("inf"), 0, 0]), (9, [1, 1]), (10, []), (None, [1, 0, 0]), (0, [1, 0, 0]), (200, None)]
    got = found(neighbours.search(frame(spark, good + odd), F.col("vec_id") % 100 == 0))
    want = brute(good, 100)
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    assert neighbours.search(frame(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    assert neighbours.search(frame(spark, [(0, [1, 2])]), F.col("vec_id") % 100 == 0).collect() == []
    assert neighbours.search(frame(spark, good[1:4]), F.col("vec_id") % 100 == 0).collect() == []
    assert found(neighbours.search(frame(spark, [(0, [2.0]), (1, [1.0]), (2, [-1.0])]), F.lit(True)))[0] == [(1, 1.0), (2, 3.0)]


def test_probe_order_and_rotation():
    h = neighbours.Hashes(6, 2, 2)
    v = np.random.default_rng(0).normal(size=(5, 6))
    turned = h.turned(v, 1, 1)
    assert np.allclose((turned[:, :8] ** 2).sum(1), 1) and np.allclose(turned[:, :8], -turned[:, 8:])
    for x, cell in zip(v, h.cells(v, 0)):
        probes = h.probes(x, 0, 256)
        assert probes[0] == cell and sorted(probes.tolist()) == list(range(256))
