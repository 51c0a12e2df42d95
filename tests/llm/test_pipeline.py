import random

import corpus_pipeline as cp
from pyspark.sql import functions as F

from .conftest import words_text


def sentences(rng, n):
    words = words_text(rng, n, 5000).split()
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


def test_stages_catch_what_is_planted_and_keep_the_rest(spark, tmp_path):
    rng = random.Random(7)
    item, passage = words_text(rng, 30, 5000), words_text(rng, 60, 5000)
    clean = [(k, sentences(rng, 150)) for k in range(40)]
    rows = list(clean)
    rows += [(100, clean[0][1]), (101, clean[1][1] + " end"), (102, "too short"), (103, " ".join(["BUY!!"] * 60)), (104, None), (105, "")]
    rows += [(200 + k, sentences(rng, 80) + "\n" + passage + ".\n" + sentences(rng, 50)) for k in range(3)]
    rows += [(300, sentences(rng, 60) + "\n" + item + ".\n" + sentences(rng, 60)), (301, sentences(rng, 90)), (301, sentences(rng, 90))]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == cp.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    kept = sorted([*range(40), 100, 101, 200, 201, 202, 300, 301, 301])
    assert seen[0] == kept
    assert seen[1] == sorted([*range(40), 200, 201, 202, 300, 301, 301])  # two texts of one id are no copies
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert all(passage.split()[5] + " " + passage.split()[6] not in texts[200 + k] for k in range(3)) and texts[5] == dict(clean)[5]
    assert seen[3] == [d for d in seen[2] if d != 300] and seen[4] == seen[3]
    whole = cp.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == seen[4]


def test_stages_over_odd_tables(spark, tmp_path):
    """Null and shared ids, repeated rows, extra columns that clash, and an empty table."""
    rng = random.Random(9)
    a, b, c, d = (sentences(rng, 60) for _ in range(4))
    rows = [(5, a), (301, a), (301, b), (None, c), (None, d), (None, d), (7, None), (8, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, cleaned string, kept string, row long, __row int, carried string"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 1, 2, "z") for i, t in rows], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == cp.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and none.columns == out.columns
        if k < 4:
            docs = seen[-1].withColumn("cleaned", F.lit("x")).withColumn("places", F.lit(1))
    assert sorted((str(r.doc_id), r.text) for r in seen[0].collect()) == sorted((str(i), t) for i, t in rows[:6])
    want = sorted([("5", a), ("301", b), ("None", c), ("None", d)])
    assert sorted((str(r.doc_id), r.text) for r in seen[1].collect()) == want == sorted((str(r.doc_id), r.text) for r in seen[3].collect())
