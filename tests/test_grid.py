"""Sweeps over grids, searches of many pairs and scenarios at once, the batched kernel: against brute force and against one at a time."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.operators import correlate, graph, grid, kernel, rank, synth
from tephra.plans import correlation

SCHEMA = "g int, key string, a_b0 int, a_b1 int, b_b0 int, b_b1 int, mask long"


def random_pairs(rng, groups, side, share):
    rows = []
    for g in range(groups):
        for i, j, (di, dj) in itertools.product(range(side), range(side), [(1, 0), (0, 1), (1, 1)]):
            if rng.random() < share and i + di < side and j + dj < side:
                rows.append((g, f"{2 * i + di},{2 * j + dj}", i, i + di, j, j + dj, rng.choice([1, 2, 3, -1, 5])))
    return rows


def plain_paths(rows, bit=0):
    """All paths of a group from (0, 0) to the last boundaries, by depth first search."""
    some = [r for r in rows if r[6] >> bit & 1]
    end = (max(r[3] for r in rows), max(r[5] for r in rows))
    out = []

    def walk(at, path):
        if at == end:
            return out.append("|".join(path))
        for r in some:
            if (r[2], r[4]) == at:
                walk((r[3], r[5]), [*path, r[1]])

    walk((0, 0), [])
    return out


@pytest.fixture(scope="module")
def pairs():
    return random_pairs(random.Random(4), 6, 5, 0.75)


@pytest.mark.parametrize("block", [256, 2])
def test_sweeps_equal_the_search(spark, pairs, monkeypatch, block):
    monkeypatch.setattr(grid.spread, "__defaults__", (False, block))
    df = spark.createDataFrame(pairs, SCHEMA)
    found = {g: plain_paths([(*r[:6], -1) for r in pairs if r[0] == g]) for g in range(6)}
    counts = {r.g: (int(r.n_paths), r.digits) for r in graph.count_paths(df, ["g"]).collect()}
    assert counts == {g: (len(p), str(len(p))) for g, p in found.items() if p}
    keys = {(r.g, r.key) for r in graph.on_complete_paths(df, ["g"]).collect()}
    for g, paths in found.items():
        assert not paths or {k for h, k in keys if h == g} == {k for p in paths for k in p.split("|")}
    assert {r.g: r.complete for r in graph.has_complete_paths(df, ["g"]).collect()} == {g: bool(p) for g, p in found.items()}
    kinds = {(r.g, r.key): r for r in graph.chain_breaks(df, ["g"]).collect()}
    for g, key, a0, a1, b0, b1, _ in pairs:
        r = kinds[g, key]
        assert r.n_out == sum(x[0] == g and (x[2], x[4]) == (a1, b1) for x in pairs) and r.n_in == sum(x[0] == g and (x[3], x[5]) == (a0, b0) for x in pairs)
        assert r.is_complete == any(key in p.split("|") for p in found[g])


def test_more_ways_than_38_digits(spark):
    side = 60
    rows = [(0, f"{2 * i + a},{2 * j + b}", i, i + a, j, j + b, -1) for i in range(side) for j in range(side) for a, b in ((1, 0), (0, 1), (1, 1)) if i + a < side and j + b < side]
    ways = [[1] * side for _ in range(side)]
    for i, j in itertools.product(range(1, side), range(1, side)):
        ways[i][j] = ways[i - 1][j] + ways[i][j - 1] + ways[i - 1][j - 1]
    got = graph.count_paths(spark.createDataFrame(rows, SCHEMA)).head()
    assert got.digits == str(ways[-1][-1]) and len(got.digits) > 38 and got.n_paths is None


@pytest.mark.parametrize("levels,most", [(None, None), (1, None), (2, 3)])
def test_masked_search_equals_one_search_a_bit(spark, pairs, levels, most):
    df = spark.createDataFrame(pairs, SCHEMA)
    both = graph.complete_paths(df, ["g"], levels, most, seed=3, mask="mask").collect()
    for bit in (0, 1, 2, 63):
        own = df.where(F.call_function("getbit", F.col("mask"), F.lit(bit)) == 1)
        # the ends are those of all pairs: groups whose own pairs end earlier have no path
        one = {(r.g, r.path) for r in graph.complete_paths(df.withColumn("mask", F.when(F.call_function("getbit", F.col("mask"), F.lit(bit)) == 1, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))), ["g"], levels, most, seed=3, mask="mask").collect()}
        assert {(r.g, r.path) for r in both if r.mask >> bit & 1} == one
        if levels is None:
            assert one == {(g, p) for g in range(6) for p in plain_paths([r for r in pairs if r[0] == g], bit)}
    assert own is not None


def test_cap_keeps_complete_paths(spark):
    rows = [(0, f"{2 * i + a},{2 * j + b}", i, i + a, j, j + b, -1) for i in range(3) for j in range(3) for a, b in ((1, 0), (0, 1), (1, 1)) if i + a < 3 and j + b < 3]
    every = plain_paths(rows)
    got = [r.path for r in graph.complete_paths(spark.createDataFrame(rows, SCHEMA), ["g"], most=2).collect()]
    assert set(got) <= set(every) and 2 < len(got) < len(every)


def test_largest_sets(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, "|".join(rng.sample("abcdefgh", rng.randint(1, 6)))) for k in range(120)] + [(500, "z"), (501, "z|z"), (502, "")]
    df = spark.createDataFrame(rows, "mapping_id long, path string")
    sets = {k: frozenset(p.split("|")) for k, p in rows}
    want = {k for k, s in sets.items() if not any(s < t for t in sets.values()) and k == min(j for j, t in sets.items() if t == s)}
    for first in (256, 1):
        monkeypatch.setattr(rank, "FIRST", first)
        assert {r.mapping_id for r in rank.largest_paths(df).collect()} == want


# --- the kernel --------------------------------------------------------------------------------


@pytest.mark.parametrize("n,m,leaves", [(2, 2, False), (3, 3, True), (2, 9, False), (5, 9, True), (1, 7, True), (6, 6, True), (10, 10, True)])
def test_band(n, m, leaves):
    """Radius: a quarter of the shorter side, halves to even; the longer side has the difference besides; both limits open."""
    allowed = kernel.in_band(n, m, 0.25)
    radius = round(0.25 * min(n, m))
    for i, j in itertools.product(range(n), range(m)):
        low, high = (radius, radius + m - n) if n < m else (radius + n - m, radius)
        assert allowed[i, j] == (-low < j - i < high)
    assert leaves == (kernel.align_many(np.zeros((1, n, 1)), np.zeros((1, m, 1)), 0.25)[0] is not None)


def test_closed_rule_of_the_band(spark):
    sizes = [(n, m) for n in range(1, 12) for m in range(1, 12)]
    df = spark.createDataFrame(sizes, "n int, m int").withColumn("ok", correlation.leaves_a_path(F.col("n"), F.col("m"), 0.25))
    for r in df.collect():
        assert r.ok == (kernel.align_many(np.zeros((1, r.n, 1)), np.zeros((1, r.m, 1)), 0.25)[0] is not None)


@pytest.mark.parametrize("n,m,k,band", [(1, 1, 1, None), (1, 5, 1, 0.25), (4, 1, 2, None), (5, 7, 1, 0.25), (9, 6, 2, 0.25), (8, 8, 1, None)])
def test_many_at_once_equal_one_by_one(n, m, k, band):
    rng = np.random.default_rng(n * 10 + m)
    a, b = rng.integers(0, 4, (6, n, k)).astype(float), rng.integers(0, 4, (6, m, k)).astype(float)  # ties on purpose
    for x, y, found in zip(a, b, kernel.align_many(a, b, band)):
        distance, path, metrics = kernel.align(x, y, band)
        assert found[0] == pytest.approx(distance) and np.array_equal(found[1], path)
        assert found[2] == pytest.approx([metrics[q] for q in kernel.METRICS])


def test_arrays_with_nulls_and_lower_bound(spark):
    rows = [(1, [1.0, None, 2.0], [1.0, 2.0]), (2, None, [1.0]), (3, [], []), (4, [1.0, 2.0, 4.0], [9.0, 8.0, 9.5]), (5, [0.0], [3.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    got = {r.id: r for r in correlate.align_arrays(df, "a", "b").collect()}
    assert got[1].distance == 0 and [(c.i, c.j) for c in got[1].wp] == [(0, 0), (2, 1)]
    assert got[2].distance == got[3].distance == 0 and got[5].distance == 1.0
    low = {r.id: r.low for r in df.where("id > 3").withColumn("low", correlate.lower_bound("a", "b", "double")).collect()}
    assert low[4] == 17.0 and low[4] <= got[4].distance


# --- many pairs of cores -----------------------------------------------------------------------


def cores(spark, pairs, logs=1):
    rng = random.Random(11)
    value = lambda k, p: [math.sin((k + p) / 4 + d) + rng.random() / 9 for d in range(logs)]
    out = []
    for side in (0, 1):
        rows = [(p, k, float(k), value(k, p + side) if logs > 1 else value(k, p + side)[0]) for p in range(pairs) for k in range(30 + 4 * p - 3 * side)]
        kind = "array<double>" if logs > 1 else "double"
        out += [spark.createDataFrame(rows, f"pair int, idx int, depth double, v {kind}"), spark.createDataFrame([(p, float(d)) for p in range(pairs) for d in ((8, 17) if side else (9, 18))], "pair int, depth double")]
    return out


def ages(spark, pairs, slow=1.0, gap=0.0):
    """Boundary ages of both sides; the second core's lie apart by gap in the middle of pair 1, so that its chain breaks."""
    a = [(p, b, float(100 * b), 20.0, 20.0) for p in range(pairs) for b in range(4)]
    b = [(p, k, float(100 * k * slow) + (gap if p == 1 and k > 1 else 0.0), 20.0, 20.0) for p in range(pairs) for k in range(4)]
    models = [spark.createDataFrame(x, "pair int, b int, age double, pos double, neg double") for x in (a, b)]
    dated = [m.select("pair", "age", F.col("pos").alias("pos_err"), F.col("neg").alias("neg_err")).where("b != 2") for m in models]
    return models, dated


def plain(r, names):
    return tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names)


@pytest.mark.parametrize("how", [{}, {"logs": 2, "pca": True}, {"distance_limit": 6.0, "restricted": False}])
def test_pairs_at_once_equal_one_by_one(spark, how):
    how = dict(how)
    n = 2
    x = cores(spark, n, how.pop("logs", 1))
    models, dated = ages(spark, n, gap=900.0)
    names = ["path", "length", *kernel.METRICS, "perc_age_overlap"]
    whole = correlation.correlate_pairs(*x, ages=models, horizons=dated, **how)
    got = {p: sorted(plain(r, names) for r in whole.mappings.where(F.col("pair") == p).collect()) for p in range(n)}
    for p in (1,):  # whose chain is broken
        one = lambda t: t.where(F.col("pair") == p).drop("pair")  # noqa: B023, E731
        core = lambda t: one(t).withColumn("core_id", F.lit("c"))
        alone = correlation.correlate_cores(core(x[0]), core(x[2]), core(x[1]), core(x[3]), ages=tuple(map(one, models)), horizons=tuple(map(one, dated)), **how).mappings.collect()
        assert got[p] and got[p] == sorted(plain(r, names) for r in alone)


def test_metrics_of_a_path_by_the_kernel(spark):
    log_a, picks_a, log_b, picks_b = cores(spark, 1)
    found = correlation.correlate_pairs(log_a, picks_a, log_b, picks_b, band=None)
    a, b = (np.array([r.v for r in t.orderBy("idx").collect()]) for t in (log_a, log_b))
    cells = {r.key: [(c.i, c.j) for c in r.wp] for r in found.pairs.collect()}
    for r in found.mappings.collect():
        want = kernel.combined_metrics(a, b, [np.array(cells[k]) for k in r.path.split("|")], [0.0])
        assert [r[m] for m in kernel.METRICS] == pytest.approx([want[m] for m in kernel.METRICS])


def test_broken_chains_are_repaired_as_the_definition_says(spark):
    """By hand: the pairs let in again where a pair's ages leave no complete path, and no others."""
    rows = []  # a grid of 3 x 3 boundaries (two intervals a core); ten rows an interval
    for (sa, a0, a1), (sb, b0, b1) in itertools.product([(0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 2), (4, 2, 2)], repeat=2):
        if a0 != a1 or b0 != b1:
            rows.append((7, 0, f"{sa},{sb}", a0, b0, a1, b1, 1 if (sa, sb) in {(1, 1), (0, 1)} else 0, 1, 10 * a0, 10 * a1, 10 * b0, 10 * b1, a0 == a1, b0 == b1))
    edges = spark.createDataFrame(rows, "pair int, word int, key string, i long, j long, i2 long, j2 long, mask long, __any long, a_start int, a_end int, b_start int, b_end int, a_point boolean, b_point boolean")
    got = {r.key for r in correlation.repaired(edges).collect()}
    # (1,1) ends at (1, 1), (0,1) at (0, 1): what begins there is let in; nothing begins strictly below row 10 of both cores but points at the end
    dead = {r[2] for r in rows if (r[3], r[4]) in {(1, 1), (0, 1)}}
    assert got == dead


def test_scenarios_in_one_pass_equal_one_search_each(spark):
    n = 2
    log_a, picks_a, log_b, picks_b = cores(spark, n)
    models, dated = ages(spark, n)
    c = spark.createDataFrame([(5.0, 60.0, 30.0, 30.0), (12.0, 250.0, 30.0, 30.0), (20.0, 230.0, 30.0, 30.0)], "depth double, age double, pos_err double, neg_err double")
    sweep = synth.scenarios(c)
    found = correlation.scenario_mappings(log_a, picks_a, log_b, picks_b, models[0], dated[0], sweep)
    names = ["pair", "path", "length", *kernel.METRICS]
    got = {}
    for r in found.collect():
        got.setdefault(r.scenario, []).append(plain(r, names))
    assert {s.split("/")[0] for s in got} == {"restricted_age_optimal", "loose_age_optimal"}
    some = sweep.where("mask = 6 and restricted or mask = 7 and not restricted").collect()
    for s in some:
        one = correlation.scenario_mappings(log_a, picks_a, log_b, picks_b, models[0], dated[0], sweep.where(F.col("scenario") == s.scenario)).collect()
        name = s.scenario.replace("_age/", "_age_optimal/")
        assert sorted(got[name]) == sorted(plain(r, names) for r in one) and one
    fits = {r.scenario: r.n for r in correlation.sweep_fits(found, "corr_coef").collect()}
    assert fits == {s: len(r) for s, r in got.items()}


@pytest.mark.parametrize("query", [graph.on_complete_paths, graph.chain_breaks])
def test_swept_pairs_are_not_exchanged_again(spark, pairs, query):
    plan = query(spark.createDataFrame(pairs, SCHEMA), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Exchange" in plan
