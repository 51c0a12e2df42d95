import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tephra.operators import agemodel, gapfill, graph, imaging, kernel, rank, series, stats, synth
from tephra.plans import correlation
from tephra.sources import logs


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_mappings_through_named_beds(spark):
    m = spark.createDataFrame([(1, "0,0|1,1|2,2|3,3", 4, 0.9), (2, "0,0|1,1|3,2|3,3", 4, 0.8), (3, "1,1|3,3", 2, 0.7), (4, "1,0|1,1|3,3", 3, 0.6)], "mapping_id int, path string, length int, corr_coef double")
    a = spark.createDataFrame([(1, "X?"), (2, "Y"), (0, "")], "b int, bed string")
    b = spark.createDataFrame([(1, " X"), (2, "Z")], "b int, bed string")
    w = {"corr_coef": 1.0}
    assert rows(rank.boundary_mappings(m, a, b, w, 5, needed=("corr_coef",)), "mapping_id", "n_covered", "ranking_datums") == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4)]
    none = spark.createDataFrame([(5, "X")], "b int, bed string")  # no path comes through (1, 5): the longest compete
    assert rows(rank.boundary_mappings(m, a, none, w, 5, needed=("corr_coef",)), "mapping_id", "ranking_datums") == [(1, 1), (2, 2)]
    assert rank.best_datum(rank.boundary_mappings(m, a, b, w, 5, needed=("corr_coef",)), "corr_coef").collect()[0][0] == 0.9
    assert [r.mapping_id for r in rank.by_metric(m, "corr_coef", first=2).collect()] == [4, 3]
    pq = spark.createDataFrame([(["a", "b"], ["b"]), (["a"], ["b"]), ([], ["b"])], "p array<string>, q array<string>")
    assert [r[0] for r in pq.select(rank.is_within(F.col("p"), F.col("q"))).collect()] == [True, False, True]


def test_whole_correlation_of_many_pairs_equals_brute_force(spark):
    """Every mapping's metrics from its matched cells in the whole logs, plainly."""
    rng = random.Random(4)
    data, bounds = {}, {}
    for pair in (0, 1):
        for c, n in (("a", 30 + pair), ("b", 26)):
            data[pair, c] = [math.sin(k / 4 + pair) + rng.random() / 9 for k in range(n)]
            bounds[pair, c] = [0, 11 + pair, n - 1] if c == "a" else [0, 9, 18, n - 1]
    log = lambda c: spark.createDataFrame([(p, k, float(k), v) for (p, x), vs in data.items() if x == c for k, v in enumerate(vs)], "pair long, idx int, depth double, v double")
    pick = lambda c: spark.createDataFrame([(p, float(d)) for (p, x), ds in bounds.items() if x == c for d in ds[1:-1]], "pair long, depth double")
    got = correlation.correlate_pairs(log("a"), pick("a"), log("b"), pick("b"), band=None, shortest_levels=None, most_paths=None).mappings.collect()
    one = correlation.correlate_cores(*[log(c).where("pair = 1").withColumnRenamed("pair", "core_id") for c in "ab"], *[pick(c).where("pair = 1").withColumnRenamed("pair", "core_id") for c in "ab"], band=None, shortest_levels=None, most_paths=None).mappings.collect()
    assert len(got) == 2 * 25 and len(one) == 25  # Delannoy(2, 3)
    for r in [*got, *one]:
        pair = r["pair"] if "pair" in r.asDict() else 1
        a, b = data[pair, "a"], data[pair, "b"]
        cells = set()
        for step in r.path.split("|"):
            s, t = map(int, step.split(","))
            span = lambda k, ds: (ds[k // 2], ds[k // 2 + k % 2])
            (a0, a1), (b0, b1) = span(s, bounds[pair, "a"]), span(t, bounds[pair, "b"])
            _, path, _ = kernel.align(a[a0 : a1 + 1], b[b0 : b1 + 1])
            cells |= {(int(i) + a0, int(j) + b0) for i, j in path}
        cells = sorted(cells)
        n, m = len(a), len(b)
        cost = sum(abs(a[i] - b[j]) for i, j in cells)
        k = max(n, m)
        straight = math.sqrt(sum((a[int(q * (n - 1) / (k - 1))] - b[int(q * (m - 1) / (k - 1))]) ** 2 for q in range(k)))
        x, y = [a[i] for i, _ in cells], [b[j] for _, j in cells]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        corr = sum((p - mx) * (q - my) for p, q in zip(x, y)) / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
        want = {"norm_dtw": cost / (n + m), "dtw_ratio": cost / (straight + 1e-10), "perc_diag": 100 * (1 - sum(abs(i / (n - 1) - j / (m - 1)) for i, j in cells) / len(cells)), "dtw_warp_eff": 100 * (k - 1) / (len(cells) - 1), "corr_coef": corr}
        assert {c: pytest.approx(v, rel=1e-6) for c, v in want.items()} == {c: r[c] for c in want}, r.path
        assert r.dtw_warp_eff <= 100 + 1e-9


def test_nulls_keep_their_places_and_subsequences_end_where_they_fit(spark):
    from tephra.operators import correlate

    df = spark.createDataFrame([(1, [1.0, None, 2.0, 3.0], [1.0, 2.0, None, 3.0])], "k int, a array<double>, b array<double>")
    r = correlate.align_arrays(df, "a", "b").head()
    assert [tuple(c) for c in r.wp] == [(0, 0), (2, 1), (3, 3)] and r.distance == 0
    distance, path, _ = kernel.align([5.0, 6.0, 7.0], [0.0, 1.0, 5.0, 6.0, 7.0, 1.0, 0.0], subsequence=True)
    assert distance == 0 and path.tolist() == [[0, 2], [1, 3], [2, 4]]


def test_scans_images_and_ages_from_files(spark, tmp_path):
    px = [[(10, 20, 30), (40, 50, 60)], [(1, 2, 3), (255, 0, 128)], [(9, 8, 7), (6, 5, 4)]]
    raw = b"".join(b"\0" + bytes(v for p in line for v in p) for line in px)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "b.txt").write_text("no picture")
    got = rows(logs.load_images(spark, str(tmp_path)), "row", "col", "r", "g", "b")
    assert got == [(i, j, *px[i][j]) for i in range(3) for j in range(2)]
    (tmp_path / "ages.csv").write_text("d,a,p,n,more\n10,100,5,6,x\nbad,1,1,1,y\n20,,7,8,z\n")
    assert [tuple(r) for r in logs.load_depth_ages(spark, str(tmp_path / "ages.csv")).orderBy("depth").collect()] == [(10, 100, 5, 6), (20, None, 7, 8)]
    for k in range(2):
        (tmp_path / f"s{k}.scan").write_bytes(bytes([k, 1, 2, 3, 4]))
    (tmp_path / "s9.scan").write_bytes(b"short")

    def parse(data):
        if data == b"short":
            raise ValueError("no scan")
        return data[0], [list(data[1:3]), list(data[3:5])]

    assert rows(logs.load_scans(spark, f"{tmp_path}/*.scan", parse, force=True), "z", "row", "col", "v") == [(z, i, j, 2 * i + j + 1) for z in range(2) for i in range(2) for j in range(2)]
    with pytest.raises(Exception, match="no scan"):
        logs.load_scans(spark, f"{tmp_path}/*.scan", parse).count()
    vox = spark.createDataFrame([("v", x, y, z, 100.0 * x + 10 * y + z) for x in range(3) for y in range(4) for z in range(5)], "id string, row int, col int, z int, v double")
    assert rows(imaging.plane(vox, "z", 2), "v") == sorted((100.0 * x + 10 * y + 2,) for x in range(3) for y in range(4)) == rows(imaging.middle_plane(vox, ["id"], "z"), "v")
    with pytest.raises(ValueError):
        imaging.plane(vox, "z", 5)
    with pytest.raises(ValueError):
        imaging.crop_rows(imaging.plane(vox, "z", 1), ["id"], "row", 2, 1)
    log = spark.createDataFrame([(2.0, 5.0), (1.0, None)], "depth double, v double")
    logs.write_log(log, f"{tmp_path}/out", {"depth": "SB_DEPTH_cm", "v": "MS"})
    assert [tuple(r) for r in logs.read_csv(spark, f"{tmp_path}/out").collect()] == [("1.0", None), ("2.0", "5.0")]
    assert rows(logs.clean_picks(spark.createDataFrame([("3", "2"), ("x", "1"), ("1", "1.5"), ("2", "1")], "depth string, category string")), "depth", "category") == [(2.0, 1), (3.0, 2)]


def prominences(y, least):
    out = []
    for p in range(1, len(y) - 1):
        if y[p] > y[p - 1] and y[p] >= y[p + 1]:
            low = []
            for side in (range(p - 1, -1, -1), range(p + 1, len(y))):
                lowest = y[p]
                for k in side:
                    if y[k] > y[p]:
                        break
                    lowest = min(lowest, y[k])
                low.append(lowest)
            if y[p] - max(low) >= least:
                out.append((p, y[p] - max(low)))
    return out


def test_prominent_extremes_and_matched_overlaps(spark):
    rng = random.Random(3)
    y = [float(rng.randrange(100)) for _ in range(60)]
    curve = spark.createDataFrame([("c", k, v) for k, v in enumerate(y)], "id string, idx int, v double")
    assert rows(imaging.extremes(curve, ["id"], "idx", "v", 20.0), "idx", "prominence") == prominences(y, 20)
    y = [60 * math.sin((k / 16) ** 2) for k in range(60)]
    curve = spark.createDataFrame([("c", k, v) for k, v in enumerate(y)], "id string, idx int, v double")
    other = spark.createDataFrame([("c", k, v) for k, v in enumerate(y[-20:] + [rng.random() for _ in range(30)])], "id string, idx int, v double")
    got = {r.overlap: r for r in imaging.matched_overlaps(curve, other, ["id"], "idx", "v", 10, 30, 20.0).collect()}
    assert len(got) == 21 and max(got.values(), key=lambda r: r.score).overlap == 20 and got[20].bonus >= 2.0 and got[20].r == pytest.approx(1.0)


def test_synthetic_cores_fits_and_sweeps(spark):
    x = [(c, float(k), math.sin(k / (3 + c)) + k / 99) for c in range(3) for k in range(60)]
    log = spark.createDataFrame(x, "core_id int, depth double, v double")
    picks = spark.createDataFrame([(c, d, 2) for c in range(3) for d in (0.0, 12.0, 25.0, 40.0, 59.0)], "core_id int, depth double, category int")
    pool = synth.pool_slices(picks, log).withColumn("seg", F.col("core_id") * 10 + F.col("seg")).drop("core_id")
    assert rows(pool, "seg", "length", F.size("values")) == sorted((10 * c + k, n, int(n)) for c in range(3) for k, n in ((2, 13.0), (3, 15.0)))
    la, pa, lb, pb = synth.synthetic_pairs(pool, 3, 50.0, 60.0, seed=5)
    again = synth.synthetic_pairs(pool.repartition(7), 3, 50.0, 60.0, seed=5)[0]
    assert rows(la, "core_id", "idx", "depth", "v") == rows(again, "core_id", "idx", "depth", "v")
    assert la.agg(F.max("depth")).head()[0] <= 50 and lb.groupBy("core_id").count().count() == 3
    assert rows(la.groupBy("core_id").agg((F.max("idx") + 1 - F.count("*")).alias("d")), "d") == [(0,)] * 3
    assert pa.join(la.groupBy("core_id").agg(F.max("depth").alias("m")), "core_id").where("depth > m").count() == 0
    long = synth.synthetic_logs(pool, spark.range(1).withColumnRenamed("id", "run"), 300.0, 1, repetition=True)[0]
    assert long.agg(F.max("depth")).head()[0] > 200
    each, pooled = correlation.synthetic_fits(pool, 3, 50.0, 60.0, seed=5, band=None)
    assert each.count() == 3 and pooled.head().n == each.agg(F.sum("n")).head()[0] and abs(pooled.head()["mean"]) <= 1

    c = spark.createDataFrame([(10.0, 100.0), (20.0, 400.0), (30.0, 500.0)], "depth double, age double")
    sweep = synth.scenarios(c)
    assert sweep.count() == 14 and rows(sweep.where("mask = 5 and restricted"), "size", "members") == [(2, [(10.0, 100.0), (30.0, 500.0)])]
    assert synth.scenarios(c, most_in_layer=1).count() == 6
    pairs = spark.createDataFrame([(0, "1,1", 0.0, 100.0, 0, 1), (0, "3,3", 100.0, 500.0, 1, 2), (0, "3,1", 450.0, 500.0, 0, 1)], "p int, key string, a_age0 double, a_age1 double, b_b0 int, b_b1 int")
    maps = spark.createDataFrame([(0, "1,1|3,3", 0.5), (0, "3,1|3,3", 0.1)], "p int, path string, v double")
    depths = spark.createDataFrame([(0, 0, 0.0), (0, 1, 10.0), (0, 2, 30.0)], "p int, b int, depth double")
    fits = {r.scenario: r for r in correlation.scenario_fits(pairs, maps, c, sweep, depths, "p", "v", 1000.0).collect()}
    assert fits["restricted_age/7"].n == 1 and fits["restricted_age/7"]["mean"] == 0.5 and fits["loose_age/7"].n == 2 and fits["restricted_age/7"].n_constraints == 3


def test_saved_fits_give_values(spark):
    fits = spark.createDataFrame([("a", True, True, 2, 0.5, 0.1), ("a", True, True, 2, 0.5, 0.1), ("b", False, True, 3, 0.0, 1.0), ("c", True, False, 1, 0.0, 1.0)], "s string, restricted boolean, shortest_path_search boolean, n_constraints int, mean double, std double")
    hist = spark.createDataFrame([("a", 0.0, 0.5, 25.0, 8), ("a", 0.5, 0.5, 75.0, 8)], "s string, lo double, width double, pct double, n int")
    got = stats.quality_table(fits, hist, ["s"])
    assert rows(got.where("s = 'a'"), "value") == [(0.125,), (0.375,)] + [(0.5 + (k - 0.5) / 12,) for k in range(1, 7)] or len(rows(got.where("s = 'a'"), "value")) == 8
    b = got.where("s = 'b'").agg(F.avg("value"), F.stddev_pop("value"), F.count("*")).head()
    assert abs(b[0]) < 1e-9 and abs(b[1] - 1) < 0.1 and b[2] == 1000
    assert rows(stats.quality_table(fits, hist, ["s"], [True]).select("s").distinct(), "s") == [("a",)]
    t = spark.createDataFrame([("x", 2.0, 0.9, "large")], "g string, t_stat double, cohens_d double, effect string")
    assert rows(stats.with_unselected(t, spark.createDataFrame([("x",), ("y",)], "g string"), ["g"]), "g", "t_stat", "effect") == [("x", 2.0, "large"), ("y", 0.0, "negligible")]


def test_age_ends_start_filter_caps_and_thirds(spark):
    model = spark.createDataFrame([(50.0, 1.0, 2.0), (10.0, 3.0, 4.0), (90.0, 5.0, 6.0)], "est_age double, pos double, neg double")
    h = spark.createDataFrame([(40.0, 1.0, 1.0)], "age double, pos_err double, neg_err double")
    assert rows(agemodel.with_ends(h, model), "age") == [(10.0,), (40.0,), (90.0,)]
    s = spark.createDataFrame([(0, 0, 0, 0, 0, True), (1, 0, 1, 0, 9, False), (2, 1, 1, 9, 9, True)], "seg_id int, b0 int, b1 int, start_idx int, end_idx int, is_point boolean")
    pairs = graph.segment_pairs(s, s)
    every, started = (graph.complete_paths(pairs, starts=x) for x in (None, graph.FIRST_STEPS))
    assert rows(every, "path") == rows(started, "path") == [("0,1|1,2",), ("1,0|2,1",), ("1,1",)]
    assert rows(graph.complete_paths(pairs, starts=["1,1"]), "path") == [("1,1",)]
    many = spark.createDataFrame([(f"p{k}", k == 0) for k in range(9)], "path string, is_complete boolean")
    kept = graph.cap_paths(many, 3)
    assert kept.count() == 4 and kept.where("is_complete").count() == 1
    log = spark.createDataFrame([("a", float(k)) for k in range(9)], "core_id string, depth double")
    assert rows(graph.thirds(log), "depth") == [(3.0,), (6.0,)]


def test_logs_are_filled_together(spark):
    rng = random.Random(1)
    truth = [math.sin(k / 7) * 10 for k in range(150)]
    ms = spark.createDataFrame([("c", float(k), None if 60 <= k < 75 else truth[k]) for k in range(150)], "core_id string, depth double, ms double")
    ct = spark.createDataFrame([("c", k + 0.2, truth[k] * 2 + rng.random() / 50, -1.0 if k == 5 else 3.0 + k / 50) for k in range(150)], "core_id string, z double, ct double, ct_std double")
    kinds = {"MS": gapfill.LogKind(("ms",)), "CT": gapfill.LogKind(("ct", "ct_std"), ("depth", "z"), ("<", -30.0), 1, 2.0)}
    out = gapfill.fill_logs({"MS": ms, "CT": ct}, kinds, "xgb", rounds=10)
    got = {int(r.depth): r.ms for r in out["MS"].collect()}
    assert len(got) == 150 and all(v is not None for v in got.values()) and max(abs(got[k] - truth[k]) for k in range(60, 75)) < 6
    assert out["CT"].columns == ["core_id", "depth", "ct", "ct_std"]
    assert gapfill.weights_for(["f_MS", "f_hiresMS"], {"MS": 2.0}) == {"f_MS": 2.0} and gapfill.weights_for(["f_hiresMS"], {"MS": 2.0, "hires": 3.0}, True) == {"f_hiresMS": 6.0}


def test_forward_frames_are_linear(spark):
    import time

    def seconds(n):
        df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("depth"), F.when(F.col("id") % 97 == 0, F.col("id").cast("double")).alias("v"), F.lit(0.0).alias("p"))
        start = time.perf_counter()
        series.blend_gaps(df, ["k"], "depth", "v", "p").write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(200_000) < 30


def test_whole_cores_have_ages_from_top_to_end(spark):
    c = spark.createDataFrame([("a", 100.0, 1000.0, 5.0, 5.0, True)], "core_id string, depth double, age double, pos_err double, neg_err double, in_seq boolean")
    p = spark.createDataFrame([("a", 50.0), ("b", 5.0)], "core_id string, depth double")
    ends = spark.createDataFrame([("a", 200.0), ("b", 20.0)], "core_id string, depth double")
    got = rows(agemodel.whole_core_ages(p, c, ends), "core_id", "depth", "kind", "est_age")
    assert got == [("a", 0.0, "top", 0.0), ("a", 50.0, "pick", 500.0), ("a", 200.0, "end", 2000.0), ("b", 0.0, "top", 0.0), ("b", 5.0, "pick", None), ("b", 20.0, "end", None)]


def test_work_tables_can_be_removed(spark, tmp_path):
    from tephra.plans import tables

    df = tables.written(spark.range(3), "some")
    assert df.count() == 3 and tables.WORK
    tables.remove_work(spark)
    assert not tables.WORK
    with pytest.raises(Exception):
        df.count()


def test_what_is_written_can_be_read(spark, tmp_path):
    model = spark.createDataFrame([(20.0, 2.0, 0.2, 0.1), (10.0, 1.0, None, 0.1)], "depth double, est_age double, pos double, neg double")
    logs.write_age_model(model, f"{tmp_path}/m")
    assert [tuple(r) for r in logs.load_depth_ages(spark, f"{tmp_path}/m").orderBy("depth").collect()] == [(10.0, 1.0, None, 0.1), (20.0, 2.0, 0.2, 0.1)]
    fit = spark.createDataFrame([("s", 1.0)], "k string, mean double")
    logs.append_fits(fit, f"{tmp_path}/f")
    logs.append_fits(fit.withColumn("mean", F.lit(2.0)), f"{tmp_path}/f")
    assert rows(spark.read.parquet(f"{tmp_path}/f"), "mean") == [(1.0,), (2.0,)]
    old = spark.createDataFrame([(1.0, 1, "x"), (2.0, 1, "y")], "depth double, category int, bed string")
    new = spark.createDataFrame([(2.0, 3), (1.5, 1)], "depth double, category int")
    assert [tuple(r) for r in logs.upsert_picks(old, new).select("depth", "category", "bed").collect()] == [(1.5, 1, None), (2.0, 3, "y")]


def test_cleaning_profiles_pools_and_completeness(spark):
    raw = spark.createDataFrame([("a", float(k), 100.0 if k == 5 else float(k)) for k in range(11)], "core_id string, depth double, v double")
    got = gapfill.clean_log(raw, "v", ">", 50.0, 1, 20.0, None).orderBy("depth").collect()
    assert got[-1].depth == 20 and [r.depth for r in got if r.v is None] == [8.0, 10.0, 12.0]
    px = spark.createDataFrame([("i", k, 1.0 * k, 2.0, 3.0) for k in range(4)], "id string, row int, r double, g double, b double")
    prof = imaging.bin_profile(px, ["id"], "row", ["r", "g", "b"], 2).orderBy("bin").collect()
    assert [(p.r, p.g, p.r_std) for p in prof] == [(0.5, 2.0, 0.5), (2.5, 2.0, 0.5)] and prof[0].lum == pytest.approx(0.5 * 0.2126 + 2 * 0.7152 + 3 * 0.0722)
    even = imaging.bin_profile(px, ["id"], "row", ["r", "g", "b"], 2, target=10.0).agg(F.avg("lum")).head()[0]
    assert even == pytest.approx(10.0)
    pool = spark.createDataFrame([(k,) for k in range(4)], "seg int")
    assert rows(synth.modify_pool(pool, "seg", [1, 9]), "seg") == [(0,), (2,), (3,)]
    pairs = spark.createDataFrame([(0, "1,1", 0, 1, 0, 1), (0, "3,3", 1, 2, 1, 2), (1, "1,1", 0, 1, 0, 1), (1, "5,5", 2, 3, 2, 3)], "p int, key string, a_b0 int, a_b1 int, b_b0 int, b_b1 int")
    assert rows(graph.has_complete_paths(pairs, ["p"]), "p", "complete") == [(0, True), (1, False)]


@pytest.mark.parametrize("method", ["rf", "xgb"])
def test_other_learners_fill_every_gap(spark, method):
    log = spark.createDataFrame([("c", float(k), None if 20 <= k < 30 else math.sin(k / 9), math.sin(k / 9) * 2) for k in range(80)], "core_id string, depth double, v double, f double")
    out = {int(r.depth): r.filled for r in gapfill.fill_gaps(log, ["f"], method, trees=15, rounds=10).collect()}
    assert len(out) == 80 and all(abs(out[k] - math.sin(k / 9)) < 0.4 for k in range(20, 30))
