import random

import numpy as np
import pytest

from tephra.llm import decontaminate as dc
from tephra.llm.common import Words

from .conftest import words_text


def distance(item, text):
    """Fewest edits from an item to any part of a text, plainly."""
    row = [0] * (len(text) + 1)
    for w in item:
        new = [row[0] + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_window_distance_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(300):
        item, text = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)
        want = distance(item.tolist(), text.tolist())
        got = dc.window_distance(item, text, len(item))
        assert got[0] == want and distance(item.tolist(), text[got[1] : got[2]].tolist()) == want
        assert (dc.window_distance(item, text, want - 1) is None) or want == 0


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k, kind = rng.randrange(len(words)), rng.randrange(3)
        words[k : k + (kind != 2)] = [] if kind == 0 else [f"edit{rng.randrange(99999)}"]
    return words


def corpus(seed, docs=150):
    rng = random.Random(seed)
    items = [(k, words_text(rng, rng.randrange(3, 60), 2000)) for k in range(40)] + [(90, None), (91, "")]
    rows, planted = [], set()
    for k in range(docs):
        words = words_text(rng, rng.randrange(200), 2000).split()
        if k % 3 == 0:
            item, text = items[rng.randrange(40)]
            size = len(text.split())
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(rng, text.upper().replace(" ", ", ").split(), rng.randrange(int(0.1 * size) + 1))
        rows.append((k, " ".join(words)))
    hashed = lambda t: Words([dc.plain((t or "").encode())], lower=True).hash.tolist()
    for d, t in rows:
        text = hashed(t)
        for i, x in items:
            item = hashed(x)
            if item and distance(item, text) <= int(0.1 * len(item)):
                planted.add((d, i))
    return items, rows, planted


def test_recall_and_precision_against_brute_force(spark, odd_docs, no_docs):
    items, rows, want = corpus(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, edits int")
    got = {(r.doc_id, r.item_id): r for r in dc.find_leaks(df, bench).collect()}
    assert set(got) <= want and len(got) >= 0.95 * len(want) > 30
    exact = {k for k, r in got.items() if r.edits == 0}
    assert exact == {(d, i) for d, i in want if distance(dict(items)[i].split(), dict(rows)[d].lower().replace(",", "").split()) == 0}
    parts = {(r.doc_id, r.item_id) for r in dc.find_leaks(df, bench, most_bytes=500).collect()}
    assert parts == set(got)
    assert dc.find_leaks(no_docs, bench).collect() == [] == dc.find_leaks(odd_docs, bench.limit(0)).collect()
    assert dc.find_leaks(odd_docs, bench).collect() == []


def test_recall_at_the_most_edits_by_length():
    """Exactly 10 % of an item's words edited, for items of 10 to 400 words."""
    rng = random.Random(11)
    for size, n in ((10, 60), (12, 40), (20, 40), (40, 30), (60, 20), (100, 15), (200, 10), (400, 6)):
        texts = [words_text(rng, size, 3000) for _ in range(n)]
        items = dc.Items(list(range(n)), [t.encode() for t in texts], dc.Search())
        docs = [" ".join(words_text(rng, 30, 3000).split() + edited(rng, t.split(), size // 10) + words_text(rng, 30, 3000).split()).encode() for t in texts]
        found = dc._matches(docs, items)
        assert sum((k, k) in found for k in range(n)) >= 0.9 * n, size


def test_documents_with_items_go_and_others_keep_their_columns(spark):
    rng = random.Random(2)
    item, short = words_text(rng, 20, 3000), "two words"
    bench = spark.createDataFrame([(1, item), (1, item), (2, short), (3, None)], "item_id long, text string")
    rows = [(1, words_text(rng, 40, 3000), "a"), (2, "x " + item + " y", "b"), (None, None, "c"), (3, "", "d"), (4, "it has Two, words here", "e"), (1, "again", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, raw string")
    kept = dc.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.raw for r in kept.collect()) == ["a", "a", "c", "d"]
    assert sorted((r.doc_id, r.item_id) for r in dc.find_leaks(df, bench).collect()) == [(2, 1), (2, 1), (4, 2)]


@pytest.mark.parametrize("size", [10, 11])
def test_short_items_with_the_edit_at_every_place(size):
    """1,000 items of each length, their one edit (another word, a word more or less) at each place in turn: all are found."""
    rng = random.Random(size)
    items = [[f"i{rng.randrange(10**6)}" for _ in range(size)] for _ in range(1000)]
    held = dc.Items(list(range(1000)), [" ".join(x).encode() for x in items], dc.Search())
    raws = []
    for k, words in enumerate(items):
        at, kind = k % size, k // size % 3
        edited = words[:at] + (["zz"] if kind == 0 else ["zz", words[at]] if kind == 1 else []) + words[at + 1 :]
        raws.append(" ".join(["before", "that", *edited, "and", "behind"]).encode())
    found = dc._matches(raws, held)
    assert {(k, k) for k in range(1000)} <= set(found)
