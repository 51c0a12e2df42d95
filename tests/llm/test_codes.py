import hashlib
import random

import numpy as np
import pytest

from tephra.llm import codes

KIND = "vec_id long, embedding array<float>, label int, code int, extra string"


def brute(rows, parts=4, entries=256, rounds=4):
    """({(id, code, error)} as sorted text, codebooks), with Python's whole numbers."""
    kept = [(i, [int(np.floor(float(x) * 1024)) for x in v], y) for i, v, y in rows]
    d = len(kept[0][1])
    w = d // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v, _ in kept:
                held[near(v[p * w : p * w + w], books[p])[1]].append(v[p * w : p * w + w])
            books[p] = [[sum(c) // len(c) for c in zip(*h)] if h else books[p][k] for k, h in enumerate(held)]
    out = []
    for i, v, _ in kept:
        best = [near(v[p * w : p * w + w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best)))
    return sorted(out, key=str), books


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(16)], rng.choice([1, 2, None])) for k in range(400)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    return rows + rows[30:33] + [(None, rows[3][1], 1), (7, rows[9][1], None)] + [(1000 + k, rows[5][1], 2) for k in range(40)]


ODD = [(1, None, 1), (2, [1.0] * 15 + [None], 1), (3, [1.0] * 15 + [float("nan")], 1), (4, [float("inf")] + [1.0] * 15, 1), (5, [], 1), (6, [1.0] * 8, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], KIND)


@pytest.mark.parametrize("entries", [256, 20])
def test_against_brute_force(spark, vectors, entries):
    got, books = codes.compress(frame(spark, vectors + ODD).repartition(3), entries=entries)
    want, want_books = brute(vectors, entries=entries)
    assert sorted(((r.vec_id, r.code, r.error) for r in got.collect()), key=str) == want
    assert [b.tolist() for b in books.books] == want_books
    assert hashlib.sha256(books.text().encode()).hexdigest() == hashlib.sha256(",".join(str(x) for b in want_books for c in b for x in c).encode()).hexdigest()


def test_label_errors(spark, vectors):
    got = codes.with_label_error(codes.compress(frame(spark, vectors))[0]).collect()
    label = {}
    for r in got:
        label[r.label] = label.get(r.label, 0) + r.error
    assert None in label and all(r.label_error == label[r.label] for r in got) and len(got) == len(vectors)


def test_large_components_are_exact(spark):
    rng = random.Random(1)
    rows = [(k, [float(rng.randrange(-90_000, 90_000)) for _ in range(16)], 1) for k in range(60)]
    got, books = codes.compress(frame(spark, rows), entries=7)
    want, want_books = brute(rows, entries=7)
    assert [b.tolist() for b in books.books] == want_books
    assert sorted(((r.vec_id, r.code, r.error) for r in got.collect()), key=str) == want


def test_only_moved_parts_are_exchanged():
    rng = np.random.default_rng(2)
    v = rng.integers(-900, 900, (500, 8)).astype("<i4")
    books = codes.Codebooks([v[:5, :4].astype(np.int64), v[:5, 4:].astype(np.int64)], [0, 4, 8])
    import pyarrow as pa

    def one(before):
        cols = [pa.array([1], pa.int64()), pa.array([v.tobytes()], pa.binary()), pa.array([before], pa.binary())]
        rows = [r for b in codes._round([pa.RecordBatch.from_arrays(cols, names=["block", "data", "codes"])], books) for r in b.to_pylist()]
        return rows[0]["codes"], rows[1:]

    made, first = one(None)
    assert len(first) == 10 and sum(r["moved"][0] for r in first) == 1000
    assert one(made)[1] == []
    was = np.frombuffer(made, "<u2").reshape(-1, 2).copy()
    other = (was[17, 1] + 1) % 5
    now, was[17, 1] = was[17, 1], other
    moved = {r["entry"]: r["moved"] for r in one(was.tobytes())[1]}
    assert moved == {now: [1, *v[17, 4:].tolist()], other: [-1, *(-v[17, 4:]).tolist()]}


def test_nothing_kept(spark):
    for rows in ([], ODD[:5]):
        got, books = codes.compress(frame(spark, rows))
        assert got.collect() == [] and books is None
        assert codes.with_label_error(got).collect() == []
