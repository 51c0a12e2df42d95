import random
import re

import numpy as np
import pytest

from tephra.llm import components, jaccard

from .conftest import words_text


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for k, x in enumerate(sets):
        for g in x:
            index.setdefault(g, []).append(k)
    pairs = {(i, j) for g in index.values() for i in g for j in g if i < j}
    for i, j in pairs:
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (d, _) in enumerate(rows):
        r = find(k)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return sorted(((d, len(x), least[find(k)]) for k, ((d, _), x) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(df, **how):
    return sorted((tuple(r) for r in jaccard.components_of(df, jaccard.Similarity(**how)).collect()), key=str)


def test_odd_documents(spark, odd_docs, no_docs):
    assert run(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert run(no_docs) == []


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        k = rng.randrange(len(w) + 1)
        w[k : k + rng.choice((0, 1))] = [f"n{rng.randrange(10**6)}"] if rng.random() < 0.8 else []
    return " ".join(w)


@pytest.mark.parametrize("frequent,group", [(10, 200), (3, 4), (10**9, 3)])
def test_near_copies_at_the_border(spark, frequent, group):
    rng = random.Random(group)
    passage = words_text(rng, 50, 3000)
    rows = []
    for size in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 20, 25, 36, 40, 64, 70, 71, 90, 130, 260, 500):
        for _ in range(3):
            base = words_text(rng, size, 3000)
            rows += [base] + [edited(rng, base, rng.randrange(1, 2 + size // 20)) for _ in range(rng.choice((2, 6)))]
            rows += [base + " " + words_text(rng, max(1, size // 4), 3000)]
    base = words_text(rng, 100, 3000)
    rows += [edited(rng, base, rng.randrange(1, 6)) for _ in range(60)] + [base] * 5
    rows += [passage + " " + words_text(rng, rng.randrange(4, 40), 3000) for _ in range(60)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got, want = run(df, frequent=frequent, group=group, held=20_000), brute(rows)
    assert got == want


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 200 + k) for k in range(50)] + [(7, 7), (300, 299), (300, 299)]
    links += [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)]
    rng.shuffle(links)
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}


def test_sketches_never_overstate_a_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(300):
        pool = rng.integers(0, 2**56, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 390))) for _ in range(2))
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_a_set_indexes_the_same_alone_as_among_others():
    rng = random.Random(8)
    texts = [words_text(rng, n + 4, 10**6).encode() for n in (3, 9, 12, 17, 17, 20, 36, 70, 130, 17)]
    none = np.zeros(0, np.uint64)
    of = lambda raws: jaccard.signatures(jaccard.Sets(raws, 5), 3, 4, none)
    sig, doc, _ = of(texts)
    for k, text in enumerate(texts):
        assert sorted(of([text])[0].tolist()) == sorted(sig[doc == k].tolist())
    assert len(of([texts[3]])[0]) == 2 * 6  # H + 1 of each band


def test_links_at_the_border_with_one_row_a_partition(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(12):  # 17 and 15 shingles that share 14
        w = words_text(rng, 21, 10**6).split()
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w[:18], "other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows), "doc_id")
    assert run(df) == brute(rows)


def test_linked_sets_share_a_signature_whatever_is_frequent():
    """Every pair at the border meets, also where whole segments are frequent and their neighbourhoods take over."""
    rng = np.random.default_rng(3)
    ways = set()
    for trial in range(1500):
        n = int(rng.choice((9, 12, 16, 17, 24, 33, 40, 64, 70, 120, 250)))
        pool = np.unique(rng.integers(0, 2**56, 2 * n).astype(np.uint64))
        rng.shuffle(pool)
        one = pool[:n]
        gone, more = int(rng.integers(0, n // 7 + 1)), int(rng.integers(0, n // 7 + 1))
        two = np.concatenate((one[gone:], pool[n : n + more]))
        if 4 * (n - gone) < 3 * (n + more):
            continue

        def sets(*some):
            out = jaccard.Sets.__new__(jaccard.Sets)
            out.n = np.array([len(x) for x in some])
            out.token = np.concatenate([np.sort(x) for x in some])
            out.off = np.concatenate(([0], np.cumsum(out.n)))
            return out

        both = sets(one, two)
        every, doc, _ = jaccard.signatures(both, 3, 4, None)
        # a segment that is frequent makes all its one-deletion signatures frequent
        hot = set()
        for band in range(4, 10):
            sig, of, size, fewer, seg = jaccard._segments(both, np.full(2, band), both.n > 8)
            chosen = rng.random(len(sig)) < rng.choice((0.0, 0.3, 0.6, 0.9))
            hot |= set(sig[chosen].tolist()) | set(fewer[chosen[seg]].tolist())
        frequent = np.array(sorted(hot), np.uint64)
        sig, doc, is_hot = jaccard.signatures(both, 3, 4, frequent)
        assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist()), (n, gone, more)
        ways.add((bool(is_hot.any()), len(sig) > len(np.unique(sig)) and bool((np.bincount(doc) > n).any())))
    assert len(ways) > 1
