import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tephra.llm import lm

from .conftest import words_text


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


class Plain:
    """The tree by its definition, over words: every state in one dictionary, every distribution whole."""

    def __init__(self, rows, held, tree):
        self.tree, self.count, self.next = tree, Counter(), defaultdict(Counter)
        for d, t in rows:
            if not held(d):
                history = []
                for x in [*tokens(t), None]:
                    self.count[x] += 1
                    for s in self.suffixes(history)[1:]:
                        self.next[s][x] += 1
                    history.append(x)
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.kept = {(): True}
        for s in sorted(self.next, key=len):
            n, have = sum(self.next[s].values()), self.have(s)
            gain = sum(c * math.log(self.p(x, s, True) / self.p(x, s[1:])) for x, c in have.items())
            self.kept[s] = n >= tree.least and gain > tree.divergence

    @staticmethod
    def suffixes(history):
        """The empty one, that of one token and that of two, oldest first; a text's first token has START alone before it."""
        return [(), ("<s>",)] if not history else [(), (history[-1],), (history[-2] if len(history) > 1 else "<s>", history[-1])]

    def have(self, s):
        n = sum(self.next[s].values())
        return {x: c for x, c in self.next[s].items() if c >= 2 and c >= self.tree.share * n} if n >= self.tree.least else {}

    def p(self, x, s, as_kept=False):
        if not s:
            return (self.count[x] + self.v / (self.v + 1)) / (self.n + max(self.v, 1))
        shorter = self.p(x, s[1:])
        if not (as_kept or self.kept.get(s)):
            return shorter
        n, have = sum(self.next[s].values()), self.have(s)
        return have.get(x, 0) / (n + self.tree.mu) + (1 - sum(have.values()) / (n + self.tree.mu)) * shorter

    def score(self, text):
        history, total = [], 0.0
        for x in [*tokens(text), None]:
            total += math.log10(self.p(x, self.suffixes(history)[-1]))
            history.append(x)
        return total

    def row(self, d, t, held):
        c = [self.count[x] for x in [*tokens(t), None]]
        return d, held(d), len(c), sum(k > 0 for k in c), self.n, sum(math.log10((k + 1) / (self.n + self.v + 1)) for k in c), self.score(t)


def check(df, rows, held, condition, tree):
    plain = Plain(rows, held, tree)
    got = sorted((tuple(r) for r in lm.score_texts(df, condition, tree=tree).collect()), key=str)
    want = sorted((plain.row(d, t, held) for d, t in rows), key=str)
    assert len(got) == len(want)
    by = defaultdict(list)
    for r in want:
        by[r[:5]].append(r)
    for r in got:
        near = min(by[r[:5]], key=lambda w: abs(w[6] - r[6]) + abs(w[5] - r[5]))
        assert r[5] == pytest.approx(near[5], rel=1e-6) and r[6] == pytest.approx(near[6], rel=1e-6), (r, near)
        by[r[:5]].remove(near)
    return plain


def markov(rng, n, words=40):
    """Text in which what follows depends on two words."""
    out = ["a0", "a1"]
    while len(out) < n:
        seed = hash((out[-2][1:], out[-1][1:])) if rng.random() < 0 else int(out[-1][1:]) * 7 + int(out[-2][1:]) * 3
        out.append(f"a{(seed + rng.choice((0, 0, 0, 1, 5))) % words}" if rng.random() < 0.8 else f"a{rng.randrange(words * 20)}")
    return " ".join(out)


@pytest.mark.parametrize("wide", [2_000_000, 60])
def test_scores_equal_those_of_the_plain_tree(spark, wide):
    rng = random.Random(4)
    rows = [(k, markov(rng, rng.randrange(2, 300))) for k in range(120)] + [(702, "one two unseen"), (702, "one two unseen"), (800, None), (801, "a1 A1 a1 " * 60), (802, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tree = lm.Tree(least=8, share=0.01, divergence=2.0, mu=2.0, wide=wide)
    plain = check(df, rows, lambda d: d % 7 == 2, F.col("doc_id") % 7 == 2, tree)
    assert {len(s) for s, k in plain.kept.items() if k} == {0, 1, 2}  # contexts of every length are in use


@pytest.mark.parametrize("often", [2_000_000, 40])
def test_rare_words_take_their_counts_along(spark, monkeypatch, often):
    monkeypatch.setattr(lm, "FREQUENT", often)
    rng = random.Random(9)
    rows = [(k, markov(rng, 200)) for k in range(60)] + [(100 + k, words_text(rng, 50, 3000)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(df, rows, lambda d: d % 7 == 2, F.col("doc_id") % 7 == 2, lm.Tree(least=5, share=0.01, divergence=1.0, wide=150))


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(odd_docs, rows, lambda d: d is not None and d % 7 == 2, F.col("doc_id") % 7 == 2, lm.Tree(least=3, divergence=0.5))
    assert lm.score_texts(no_docs, F.lit(False)).collect() == []
    alone = lm.score_texts(odd_docs, F.lit(True)).collect()  # nothing to learn from
    assert {r.train_tokens for r in alone} == {0} and all(r.score <= 0 for r in alone)


def test_the_tree_is_a_distribution_and_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(5)
    rows = [(k, markov(rng, 400)) for k in range(150)]
    held = lambda d: d % 7 == 2
    plain = Plain(rows, held, lm.Tree(least=20))
    for s in ((), ("a1",), ("a0", "a1"), ("<s>",)):
        assert sum(plain.p(x, s) for x in plain.count) + plain.p("never seen", s) == pytest.approx(1)
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 7 == 2, tree=lm.Tree(least=20)).where("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert got[0] > 0.95 * got[1]


def test_rows_in_another_order_at_each_read(spark, odd_docs):
    """Each partition's rows come in another order at every read, as they may out of a shuffle: the scores are the same."""
    import time

    def shuffled(frames):
        whole = [f for f in frames]
        for f in whole:
            yield f.sample(frac=1, random_state=time.time_ns() % 2**31)

    docs = odd_docs.select("doc_id", "text").repartition(2)
    moving = docs.mapInPandas(shuffled, "doc_id double, text string").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.col("doc_id") % 7 == 2
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 6), r.held_out)
    assert sorted(map(key, lm.score_texts(moving, held).collect())) == sorted(map(key, lm.score_texts(docs, held).collect()))


def test_as_many_words_are_known_as_the_limit_allows(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 5)
    counted = lambda *n: spark.createDataFrame(list(enumerate(n)), "word long, n long")
    assert lm._often(counted(900, 20, 5, 1, 0)) == 0  # a share of all tokens would leave out 20, 5 and 1
    assert lm._often(counted(900, 20, 5, 4, 3, 3, 1)) == 3
    assert lm._often(counted(0, 0)) == 0


def test_rare_tokens_of_many_slices_go_on_in_few_rows():
    word = lm.mix(lm.np.arange(300, dtype=lm.U)) | lm._NEW
    none = lm.np.zeros(0, lm.U)
    known = lm.Known(none, none.astype(int), none, none.astype(int), none, none.astype(int), none, none.astype(int), none, none, 900, 300, 300, 3, lm.Tree(), 4)
    asked = []
    for k in range(300):  # a token of each of so many slices
        one = lambda v, kind=lm.U: lm.np.array([v], kind)
        asked += lm._packed(one(0, int), lm._RARE, one(1000 + k), one(0, int), one(1, bool), one(7), one(lm._NONE), word[k : k + 1], target=one(k % 2, lm.np.int32))
    words = [lm._row(0, lm._WORDS, x=word.tobytes(), c=lm.np.full(300, 3).tobytes())]
    (made,) = lm._own_words([lm._batch(words + asked)], type("Held", (), {"value": known}))
    rows = made.filter(lm.pa.array(lm.np.asarray(made.column("kind")) == lm._TOKENS))
    assert rows.num_rows == 2 and [len(r.as_py()) for r in rows.column("key")] == [8 * 150] * 2


def test_numbers_are_coded_by_their_bits():
    np = lm.np
    rng = np.random.default_rng(3)
    odd = np.array([0, 1, 2, 1 << 63, (1 << 64) - 1, (1 << 63) - 1, (1 << 54) - 1, (1 << 53) + 1, 0], lm.U)
    for values in (odd, np.zeros(9, lm.U), np.sort(rng.integers(0, 1 << 63, 9)).astype(lm.U), odd[:0]):
        for cut in ([0, 9], [0, 1, 2, 9], [0, 4, 5, 9]) if len(values) else ([0],):
            assert (lm._decoded(lm._coded(values, np.array(cut))) == values).all()
    rank = np.minimum(rng.zipf(1.3, 4000), 1_000_000).astype(lm.U)
    (row,) = lm._coded(rank, np.array([0, 4000]))
    assert len(row) < 0.95 * len(lm._squeezed(rank))  # what planes of bytes took


def test_tokens_of_a_row_take_few_bytes_and_come_back():
    np = lm.np
    rng = np.random.default_rng(5)
    n = 30_000
    word = lambda most: np.minimum(rng.zipf(1.2, n), most).astype(lm.U)
    target, doc, w1, w2, x = rng.integers(0, 8, n), np.sort(rng.integers(0, 1000, n)), word(2000), word(100_000), word(1_000_000)
    w2[::7] = lm._NONE
    slices = np.array([11, 7], lm.U)
    doc = doc | (np.arange(n) % 2 << 32)
    learn = (doc & 0xFFFFFFFF) % 7 != 2
    rows = lm._packed(target, lm._TOKENS, slices, doc, learn, w1, w2, x)
    batch = lm._batch(rows)
    t = lm._unpacked([(batch, k) for k in range(batch.num_rows)])
    back = sorted(zip(t["key"][t["doc"] >> 32].tolist(), *(t[f].tolist() for f in ("w1", "w2", "x", "train")), (t["doc"] & 0xFFFFFFFF).tolist()))
    assert back == sorted(zip(slices[doc >> 32].tolist(), w1.tolist(), w2.tolist(), x.tolist(), learn.tolist(), (doc & 0xFFFFFFFF).tolist()))
    assert (t["c"] == -1).all() and (t["target"] == 0).all()
    assert sum(len(f) for r in rows for f in r[2:]) < 5.5 * n
