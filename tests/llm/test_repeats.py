import hashlib
import random
import re
from collections import Counter

import pytest

from tephra.llm import repeats

from .conftest import words_text


def brute(rows, n):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, n, **how):
    return sorted((tuple(r) for r in repeats.remove_repeats(df, n, digests=True, **how).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 5, 35])
def test_odd_documents(spark, odd_docs, no_docs, n):
    assert run(odd_docs, n) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], n)
    if n == 35:
        assert run(no_docs, n) == []


@pytest.mark.parametrize("held", [50, 10**6])
def test_copies_passages_and_periodic_texts(spark, held):
    rng = random.Random(held)
    shared = [words_text(rng, m, 50) for m in (34, 35, 36, 60, 100)]
    rows = []
    for k in range(120):
        t = [words_text(rng, rng.randrange(60), 2000)]
        for _ in range(rng.randrange(3)):
            t += [rng.choice(shared), words_text(rng, rng.randrange(5), 2000)]
        rows.append((k, "\n".join(t)))
    rows += [(500, "a b " * 40), (501, "x " * 36), (502, "x " * 35), (503, rows[7][1]), (504, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df, 35, held=held) == brute(rows, 35)


def test_text_without_repeats_is_kept_as_it_is(spark):
    df = spark.createDataFrame([(1, "one  two\nthree"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in repeats.remove_repeats(df, 2).collect()) == [(1, 3, 0, "one  two\nthree"), (2, 0, 0, "")]
