"""Codecs of exported mappings, first matches, prominences, saved fits without histograms."""

import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.functions import columns as C
from tephra.operators import imaging, rank, stats, synth
from tephra.plans import correlation

from .test_grid import cores


def test_codecs(spark):
    df = spark.createDataFrame([("0,0;1,2;3,2", "[ 0.5 1e-3\n 2. ]"), ("", "[]"), (None, None), ("1,1;x;2", "1, a")], "w string, n string")
    got = df.select(C.decode_warp(F.col("w")).alias("w"), C.decode_numbers(F.col("n")).alias("n")).collect()
    assert [[(c.i, c.j) for c in r.w] for r in got] == [[(0, 0), (1, 2), (3, 2)], [], [], [(1, 1)]]
    assert [r.n for r in got] == [[0.5, 0.001, 2.0], [], None, [1.0, None]]
    back = df.limit(1).select(C.encode_warp(C.decode_warp(F.col("w"))).alias("w"), C.decode_numbers(C.encode_numbers(C.decode_numbers(F.col("n")))).alias("n")).head()
    assert back.w == "0,0;1,2;3,2" and back.n == [0.5, 0.001, 2.0]


def test_exported_mappings(spark):
    found = correlation.correlate_pairs(*cores(spark, 1), shortest_levels=1)
    rows = correlation.exported(found).collect()
    cells = {r.key: {(c.i, c.j) for c in r.wp} for r in found.pairs.collect()}
    paths = {r.mapping_id: r.path for r in found.mappings.collect()}
    assert len(rows) == len(paths) > 0
    for r in rows:
        keys = paths[r.mapping_id].split("|")
        assert r.path == ";".join(f"{int(k.split(',')[0]) + 1},{int(k.split(',')[1]) + 1}" for k in keys)
        want = sorted(set().union(*(cells[k] for k in keys)))
        assert r.combined_wp == ";".join(f"{i},{j}" for i, j in want)


def test_first_match(spark):
    a = spark.createDataFrame([("T1?", 3), ("T2", 4), ("", 5)], "bed string, datum int")
    b = spark.createDataFrame([("T1", 9), ("T1 ", 7), ("T2?", 8), ("", 1)], "bed string, datum int")
    assert sorted((r.a, r.b) for r in rank.matching_pairs(a, b).collect()) == [(3, 7), (3, 9), (4, 8)]
    assert sorted((r.a, r.b) for r in rank.matching_pairs(a, b, first=True).collect()) == [(3, 7), (4, 8)]


def plain_prominences(y):
    out = []
    for k in range(1, len(y) - 1):
        if y[k] is None or y[k - 1] is None or y[k + 1] is None or not (y[k] > y[k - 1] and y[k] >= y[k + 1]):
            continue
        lows = []
        for way in (range(k - 1, -1, -1), range(k + 1, len(y))):
            low = y[k]
            for i in way:
                if y[i] is None:
                    continue
                if y[i] > y[k]:
                    break
                low = min(low, y[i])
            lows.append(low)
        out.append((k, y[k] - max(lows)))
    return out


def test_prominences(spark):
    rng = random.Random(2)
    for n in (0, 2, 3, 60, 200):
        y = [rng.choice([0, 1, 2, 3, 5, 8, None]) if n == 60 else float(rng.randrange(9)) for _ in range(n)]
        at, found = imaging.prominences(np.array([np.nan if v is None else v for v in y], float))
        assert list(zip(at.tolist(), found.tolist())) == plain_prominences(y)
    rows = [(g, k, float(v)) for g in range(3) for k, v in enumerate(rng.choices(range(12), k=40))]
    got = {(r.g, r.k): (r.prominence, r["rank"]) for r in imaging.extremes(spark.createDataFrame(rows, "g int, k int, v double"), ["g"], "k", "v", 2.0).collect()}
    want = {}
    for g in range(3):
        found = sorted(((k, p) for k, p in plain_prominences([v for h, _, v in rows if h == g]) if p >= 2), key=lambda x: (-x[1], x[0]))
        want |= {(g, k): (p, n + 1) for n, (k, p) in enumerate(found)}
    assert got == want


def test_fits_without_a_histogram_have_normal_quantiles(spark):
    fits = spark.createDataFrame([("s", True, True, 2, 10.0, 3.0, 200)], "scenario string, shortest_path_search boolean, restricted boolean, n_constraints int, mean double, std double, n int")
    hist = spark.createDataFrame([], "scenario string, lo double, width double, pct double, n int")
    got = sorted(r.value for r in stats.quality_table(fits, hist, ["scenario"]).collect())
    assert got == pytest.approx([10 + 3 * NormalDist().inv_cdf((k + 0.5) / 1000) for k in range(1000)])


def test_unknown_segments_are_warned_of(spark):
    pool = spark.createDataFrame([(1,), (2,)], "seg int")
    with pytest.warns(UserWarning, match="7"):
        assert [r.seg for r in synth.modify_pool(pool, "seg", [2, 7]).collect()] == [1]


def test_skew_normal_of_largest_likelihood(spark):
    rng = np.random.default_rng(6)
    rows, given = [], {"a": (2.0, 1.5, 4.0), "b": (-1.0, 0.3, -2.0), "c": (0.0, 1.0, 0.0)}
    for g, (loc, scale, shape) in given.items():
        d = shape / np.sqrt(1 + shape**2)
        z = d * np.abs(rng.normal(size=4000)) + np.sqrt(1 - d * d) * rng.normal(size=4000)
        rows += [(g, float(v)) for v in loc + scale * z]
    df = spark.createDataFrame(rows + [("d", 5.0), ("d", 5.0), ("d", None)], "core string, v double").repartition(3)
    got = {r.core: r for r in stats.skew_normal_mle(df, ["core"], "v").collect()}
    assert got["d"].n == 2 and got["d"].loc is None
    moments = {r.core: r for r in stats.skew_normal_fit(df.where("core != 'd'"), ["core"], "v").collect()}
    for g in "abc":
        x, one = np.array([v for h, v in rows if h == g]), np.ones(4000)
        likelihood = lambda loc, scale, shape: stats.skew_log_likelihood(x, one, np.array([loc, np.log(scale), shape]))[0]  # noqa: B023, E731
        found = likelihood(got[g].loc, got[g].scale, got[g].shape)
        start = np.array([got[g].loc, np.log(got[g].scale), got[g].shape])
        _, best = stats._climb(x, one, start)  # over all values, not over bins
        assert found >= likelihood(moments[g].loc, moments[g].scale, moments[g].shape) - 0.5 and best - found < 1e-4 * 4000
    assert abs(got["a"].shape - 4) < 0.8 and abs(got["a"].loc - 2) < 0.1 and abs(got["b"].scale - 0.3) < 0.03


def test_gradient_of_the_likelihood():
    x, w, at = np.array([-30.0, -1.0, 0.2, 3.0]), np.array([1.0, 2.0, 3.0, 1.0]), np.array([0.3, 0.1, 1.7])
    _, slope = stats.skew_log_likelihood(x, w, at)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert slope[k] == pytest.approx((stats.skew_log_likelihood(x, w, at + step)[0] - stats.skew_log_likelihood(x, w, at - step)[0]) / 2e-6, rel=1e-4)
