import math
import random

import pytest

from tephra.operators import graph, rank
from tephra.plans.correlation import correlate_cores


def core(spark, name, n, shift):
    rng = random.Random(shift)
    return spark.createDataFrame([(name, k, float(k), math.sin((k + shift) / 5) + rng.random() / 20) for k in range(n)], "core_id string, idx int, depth double, v double")


def picks(spark, name, depths):
    return spark.createDataFrame([(name, float(d)) for d in depths], "core_id string, depth double")


def delannoy(m, n):
    return 1 if not m or not n else delannoy(m - 1, n) + delannoy(m, n - 1) + delannoy(m - 1, n - 1)


def test_two_cores_have_all_paths_and_rank_them(spark):
    a, b = core(spark, "a", 60, 0), core(spark, "b", 50, 1)
    out = correlate_cores(a, b, picks(spark, "a", [20, 40]), picks(spark, "b", [25]), shortest_levels=None, most_paths=None, band=None)
    rows = out.mappings.collect()
    assert len(rows) == delannoy(3, 2) == graph.count_paths(out.pairs).head().n_paths
    assert all(r.norm_dtw >= 0 for r in rows)
    assert all(r.dtw_warp_eff > 0 for r in rows), rows[0]
    assert all(abs(r.corr_coef) <= 1 + 1e-9 for r in rows), rows[0]
    best = rank.best_mappings(out.mappings, {"norm_dtw": 1.0, "corr_coef": 1.0}, 3, shortest=False).collect()
    assert [r.ranking for r in best] == [1, 2, 3] and best[0].score >= best[1].score >= best[2].score


def test_repair_and_limits(spark):
    a, b = core(spark, "a", 40, 0), core(spark, "b", 40, 2)
    few = correlate_cores(a, b, picks(spark, "a", [10, 20, 30]), picks(spark, "b", [10, 20, 30]), shortest_levels=1, most_paths=2, band=None).mappings.collect()
    assert 1 <= len(few) <= 18 and min(r.length for r in few) == 4
    held = correlate_cores(a, b, picks(spark, "a", [20]), picks(spark, "b", [20]), distance_limit=0.0, shortest_levels=None, most_paths=None, band=None)
    assert held.pairs.count() > 0


def test_ages_rule_pairs_out_before_alignment(spark):
    a, b = core(spark, "a", 40, 0), core(spark, "b", 40, 0)
    model = lambda ages: spark.createDataFrame([(k, float(v), 1.0, 1.0) for k, v in enumerate(ages)], "b int, age double, pos double, neg double")
    free = correlate_cores(a, b, picks(spark, "a", [20]), picks(spark, "b", [20]), shortest_levels=None, most_paths=None, band=None)
    aged = correlate_cores(a, b, picks(spark, "a", [20]), picks(spark, "b", [20]), ages=(model([0, 100, 200]), model([0, 100, 200])), shortest_levels=None, most_paths=None, band=None)
    assert 0 < aged.pairs.count() < free.pairs.count()
    assert {r.path for r in aged.mappings.collect()} >= {"1,1|3,3"}
    assert aged.pairs.where("key = '1,1'").head().perc_age_overlap == pytest.approx(100.0)
