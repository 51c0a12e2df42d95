import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tephra.llm import langid

SYLLABLES = {"aa": "th he er in an re nd on".split(), "bb": "le de es en re nt on er".split(), "cc": "ch ei ie sch ung er en te".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_filters_hold_what_was_put_in_and_little_else():
    rng = np.random.default_rng(1)
    gram, lang = rng.integers(0, 2**62, 8000).astype(np.uint64), rng.integers(0, 3, 8000)
    f = langid.LanguageFilters.build(["a", "b", "c"], gram, lang)
    assert (f.masks(gram)[:, 0] >> lang & 1 == 1).all()
    other = f.masks(rng.integers(0, 2**62, 100_000).astype(np.uint64))[:, 0]
    for b in range(3):
        assert abs(np.mean(other >> b & 1) - f.false_rate[b]) < 0.003
    small = langid.LanguageFilters.build(["a", "b", "c"], gram, lang, 10, 1 << 12)
    assert small.false_rate.max() > 0.5
    lang = rng.integers(0, 130, 8000)
    wide = langid.LanguageFilters.build([f"l{k:03}" for k in range(130)], gram, lang)
    assert wide.table.shape[1] == 3 and (wide.masks(gram)[np.arange(8000), lang // 64] >> (lang % 64).astype(np.uint64) & np.uint64(1) == 1).all()


def test_predictions_equal_those_of_exact_sets(spark):
    """The same rule with sets of n-grams instead of filters, and many languages."""
    rng = random.Random(8)
    names = [f"l{k:02}" for k in range(70)]
    own = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 4))) for _ in range(9)] for n in names}
    make = lambda n, m: " ".join("".join(rng.choice(own[n]) for _ in range(rng.randrange(1, 4))) for _ in range(m))
    rows = [(k, make(names[k % 70], 40), names[k % 70]) for k in range(560)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") >= 280, docs_per_language=10**6, least=2).collect()
    count = {n: Counter() for n in names}
    for k, t, n in rows[:280]:
        count[n].update(langid.grams(t).tolist())
    count = {n: {g: m for g, m in c.items() if m >= 2} for n, c in count.items()}
    rate = {n: {g: m / sum(c.values()) for g, m in c.items()} for n, c in count.items()}
    top = {}
    for c in rate.values():
        for g, r in c.items():
            top[g] = max(top.get(g, 0), r)
    sets = {n: {g for g, r in c.items() if r >= 0.2 * top[g]} for n, c in rate.items()}
    texts = dict((k, t) for k, t, _ in rows)
    best = {k: max(names, key=lambda n: (sum(g in sets[n] for g in langid.grams(t).tolist()), [-ord(x) for x in n])) for k, t in texts.items()}
    assert sum(r.lang_pred == best[r.doc_id] for r in got) >= 0.99 * len(got)


def test_long_texts_are_counted_in_pieces():
    rng = random.Random(1)
    long = text(rng, "aa", 4000)
    whole = np.sort(langid.grams(long))
    parts = np.sort(np.concatenate(list(langid.text_grams(long, 1000))))
    assert 0 <= len(whole) - len(parts) <= len(long) // 1000 and np.isin(parts, whole).all()


def test_grams():
    assert len(langid.grams("")) == len(langid.grams("123 !\n")) == 0
    assert langid.grams("Ab").tolist() == langid.grams("..ab--").tolist()
    assert len(langid.grams("ab")) == 3 + 2


def test_held_out_accuracy_and_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(2)
    rows = [(k, text(rng, lang, rng.choice((4, 30, 200))), lang) for k in range(600) for lang in (rng.choice(sorted(SYLLABLES)),)]
    rows += [(9000, None, "aa"), (9001, "12 34", "bb"), (9002, "", None), (None, text(rng, "cc", 50), "cc"), (9003, text(rng, "aa", 50), None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(df, F.pmod("doc_id", F.lit(4)) == 2, docs_per_language=100, least=1).collect()
    assert len(got) == len(rows)
    want = {(r[0]): r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0) for k in (9000, 9001, 9002)) and by[9003].lang_pred == "aa" and by[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == odd_docs.count()
    assert langid.identify(no_docs.withColumn("lang", F.lit("x")), F.lit(True)).collect() == []
