import math
import random

import pytest
from pyspark.sql import functions as F

from tephra.functions import columns as C
from tephra.operators import agemodel, gapfill
from tephra.sources import logs
from tephra.streaming import append_batches, running_fits


def write(path, text):
    path.write_text(text)
    return str(path)


def test_logs_picks_and_constraints(spark, tmp_path):
    a = write(tmp_path / "a.csv", "SB_DEPTH_cm,MS,x\n0,1,\n1,3,\n2,,\n3,5,\n")
    b = write(tmp_path / "b.csv", "SB_DEPTH_cm,CT\n0,7\n2,7\n4,7\n")
    with pytest.warns(UserWarning):
        log = logs.load_log(spark, {"ms": a, "ct": b, "no": str(tmp_path / "none.csv")}, {"ms": "MS", "ct": "CT", "no": "z"}, "c1").orderBy("idx").collect()
    assert log[0].v == [0.0, 0.0] and log[-1].v == [1.0, 0.0] and log[-1].depth == 4
    p = write(tmp_path / "p.csv", "picked_depths_cm,category,interpreted_bed\n3,1,A?\n1,2,\n5,1,\n")
    assert sorted((r.depth, r.bed) for r in logs.load_picks(spark, p, "c1", 1).collect()) == [(3.0, "A?"), (5.0, "")]
    ages = write(tmp_path / "c1_age.csv", "core,min,max,age,pos,neg,ok,bed\nc1,10,20,100,5,6,TRUE,\nc1,30,,200,5,6,1,B\nc1,40,50,300,5,6,FALSE,C\n")
    names = {"age": "age", "pos_error": "pos", "neg_error": "neg", "min_depth": "min", "max_depth": "max", "in_sequence": "ok", "core": "core", "interpreted_bed": "bed"}
    got = logs.load_core_constraints(spark, "c1", str(tmp_path), names)
    assert [(r.depth, r.age, r.bed) for r in got.collect()] == [(15.0, 100.0, "Unknown"), (30.0, 200.0, "B")]
    assert logs.combine_constraints([got, got]).count() == 4 and ages


def test_mappings_round_trip_and_codecs(spark, tmp_path):
    df = spark.createDataFrame([([(0, 1), (2, 3)], 2, 0.12345678), ([(0, 0)], 1, 0.5)], "path array<struct<a:int,b:int>>, length int, norm_dtw double")
    logs.write_mappings(df, f"{tmp_path}/m.csv", fmt="csv")
    back = logs.load_mappings(spark, f"{tmp_path}/m.csv").orderBy("mapping_id").collect()
    assert [[tuple(s) for s in r.path] for r in back] == [[(0, 0)], [(0, 1), (2, 3)]] and float(back[1].norm_dtw) == 0.123457
    text = spark.sql("select array(named_struct('a', 1, 'b', 2), named_struct('a', 2, 'b', 4)) as p").select(C.encode_path(F.col("p")).alias("t"))
    assert text.head().t == "1,2|2,4"
    one = spark.createDataFrame([(100.0, 200.0, 150.0, 250.0), (100.0, 150.0, 200.0, 250.0), (100.0, 200.0, 120.0, 180.0)], "a double, b double, c double, d double")
    assert [round(r[0], 1) for r in one.select(C.overlap_pct(*map(F.col, "abcd"))).collect()] == [33.3, 0.0, 60.0]


@pytest.mark.parametrize("method", ["rftc", "xgblgbm"])
def test_gaps_are_filled_better_than_by_lines(spark, method):
    rng = random.Random(1)
    truth = [math.sin(k / 7) * 10 + k / 20 for k in range(300)]
    gap = set(range(60, 85)) | set(range(150, 180)) | {0}
    rows = [("c", float(k), None if k in gap else truth[k]) for k in range(300)]
    other = spark.createDataFrame([("c", k + 0.3, math.sin(k / 7) + rng.random() / 50) for k in range(300)], "core_id string, depth double, v double")
    log = gapfill.features(spark.createDataFrame(rows, "core_id string, depth double, v double"), {"o": other})
    out = {int(r.depth): r for r in gapfill.fill_gaps(log, ["f_o"], method, trees=20, rounds=15).collect()}
    assert len(out) == 300 and all(r.filled is not None for r in out.values()) and all(out[k].filled == truth[k] for k in range(300) if k not in gap)
    line = lambda k, a, b: truth[a] + (k - a) / (b - a) * (truth[b] - truth[a])
    inner = [(k, 59, 85) for k in range(60, 85)] + [(k, 149, 180) for k in range(150, 180)]
    assert sum((out[k].filled - truth[k]) ** 2 for k, _, _ in inner) < sum((line(*x) - truth[x[0]]) ** 2 for x in inner)


def test_monte_carlo_is_seeded_and_near_the_errors(spark):
    c = spark.createDataFrame([("a", 100.0, 1000.0, 50.0, 50.0, True), ("a", 200.0, 3000.0, 80.0, 80.0, True)], "core_id string, depth double, age double, pos_err double, neg_err double, in_seq boolean")
    p = spark.createDataFrame([("a", 100.0), ("a", 150.0)], "core_id string, depth double")
    one = sorted(tuple(r) for r in agemodel.monte_carlo_ages(p, c, iterations=4000, seed=3).collect())
    assert one == sorted(tuple(r) for r in agemodel.monte_carlo_ages(p, c, iterations=4000, seed=3).collect())
    assert one[0][2] == 1000 and 85 < one[0][3] < 112 and one[1][2] == 2000 and 75 < one[1][4] < 110


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("s", 1.0), ("s", 3.0), ("t", 5.0)], "k string, v double")
    df.write.parquet(f"{tmp_path}/in")
    append_batches(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    q = running_fits(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "v").writeStream.outputMode("complete").format("memory").queryName("fits").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select * from fits").collect()) == [("s", 2, 2.0, 1.0), ("t", 1, 5.0, 0.0)]
