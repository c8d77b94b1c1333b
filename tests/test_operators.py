"""Rules of the core operators on fixtures with results known by hand."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import color, geometry, numeric, text
from framewright.operators import dataset, images, kernels, learn, ledger, metrics, normalize, records, scoring, sessions, verify


def frames(spark, rows):
    """(name, second, duration) -> one group of frames."""
    start = dt.datetime(2024, 5, 1, 10)
    data = [("k", n, None if s is None else start + dt.timedelta(seconds=s), float(d)) for n, s, d in rows]
    return spark.createDataFrame(data, "k string, name string, ts timestamp_ntz, dur double")


def found(df, least=3):
    s = sessions.assign_sessions(df, ["k"], "ts", "name", "dur")
    kept, rejects = sessions.brackets(s, ["k"], "ts", "name", least)
    return sorted(r["members"] for r in kept.collect()), sorted(r["members"] for r in rejects.collect())


def test_sessions_depend_on_size(spark):
    rows = [("a1", 0, .01), ("a2", 0, .02), ("a3", 1, .04), ("b1", 18, .01), ("b2", 18, .02), ("b3", 19, .04), ("b4", 19, .08), ("b5", 20, .16), ("c1", 80, .6), ("c2", 85, 5), ("c3", 117, 30)]
    kept, rejects = found(frames(spark, rows))
    assert kept == [["a1", "a2", "a3"], ["b1", "b2", "b3", "b4", "b5"], ["c1", "c2", "c3"]] and rejects == []
    assert found(frames(spark, [("x", 0, 0), ("y", 1, 0)])) == ([], [["x", "y"]])


def test_sessions_equal_the_sequential_rule(spark):
    rng = random.Random(0)
    for _ in range(3):
        t, rows = 0, []
        for i in range(120):
            t += rng.choice([1, 5, 10, 11, 20, 30, 31, 50])
            rows.append((f"f{i:03d}", t, 0))
        want, last = [], None
        for n, s, _ in rows:
            gap = None if last is None else s - last
            if gap is not None and gap <= 30 and not (len(want[-1]) >= 3 and gap > 10):
                want[-1].append(n)
            else:
                want.append([n])
            last = s
        kept, rejects = found(frames(spark, rows))
        assert sorted(kept + rejects) == sorted(want)


def test_fallback_chunks(spark):
    rows = [(f"n{i}", None if i == 3 else i, 0) for i in range(7)]
    got = {r["name"]: (r["chunk"], r["complete"]) for r in sessions.chunks_by_name(frames(spark, rows), ["k"], "ts", "name").collect()}
    assert [got[f"n{i}"] for i in range(7)] == [(0, True)] * 3 + [(1, True)] * 3 + [(2, False)]
    assert sessions.chunks_by_name(frames(spark, [("a", 1, 0)]), ["k"], "ts", "name").count() == 0


def test_average_is_the_fold(spark):
    def fold(deltas):
        x = 0.0
        for k, d in enumerate(deltas, 1):
            a = max(1 / k, 0.2)
            x = (1 - a) * x + a * d
        return x

    rng = random.Random(1)
    cases = {"six": [1, 0, 0, 0, 0, 2], "four": [1, 2, 3, 4], "many": [rng.random() for _ in range(205)]}
    rows = [(k, i, float(d)) for k, ds in cases.items() for i, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "scene string, id long, delta double")
    got = {r["scene"]: r for r in learn.average(df, ["scene"], "id", "delta").collect()}
    for k, ds in cases.items():
        assert got[k]["shift"] == pytest.approx(fold(ds[-200:]), abs=1e-12)
    defaults = spark.createDataFrame([(k, 1.5) for k in [*cases, "none"]], "scene string, value double")
    value = {r["scene"]: r["value"] for r in learn.learned(defaults, learn.average(df, ["scene"], "id", "delta"), ["scene"]).collect()}
    assert value["six"] == pytest.approx(2.06) and value["four"] == 1.5 and value["none"] == 1.5


def sync(spark, rows):
    df = spark.createDataFrame(rows, "name string, g string, l double, a double, b double")
    return {r["name"]: r for r in normalize.sync(df, "g").collect()}


def test_sync_rules(spark):
    r = sync(spark, [("x", "g", 50., 0., 0.), ("y", "g", 60., 0., 0.), ("z", "g", 70., 0., 0.)])
    assert [r[n]["applied_dl"] for n in "xyz"] == [7.0, 0.0, -7.0]
    r = sync(spark, [("x", "g", 40., 0., 0.), ("y", "g", 60., 0., 0.), ("z", "g", 61., 0., 0.)])
    assert r["x"]["status"] == "skipped" and r["x"]["reason"] == "dl" and r["z"]["status"] == "corrected"
    r = sync(spark, [("x", "g", 48., 0., 0.), ("y", "g", 60., 0., 0.), ("z", "g", 61., 0., 0.)])
    assert r["x"]["status"] == "corrected"
    r = sync(spark, [("x", "g", 48., 0., 0.), ("y", "g", 60., 0., 0.)])
    assert r["x"]["reason"] == "no_target"
    r = sync(spark, [("x", "g", None, None, None), ("y", "g", 60., None, None), ("z", "g", 60., 1., 1.)])
    assert r["x"]["reason"] == "unmeasured" and r["y"]["reason"] == "brightness_only" and r["y"]["applied_da"] is None


def test_counts_cube(spark):
    day = [(1, "day", t, p) for t, p in [(1, 1), (1, 1), (0, 0), (0, 0)]]
    night = [(2, "night", t, p) for t, p in [(1, 1), (0, 1), (0, 1), (0, 1)]]
    df = spark.createDataFrame(day + night, "camera int, cond string, t int, p int")
    cube = {(r["camera"], r["cond"]): r for r in metrics.cube(df, ["camera", "cond"], F.col("t") == 1, F.col("p") == 1).collect()}
    top = cube[None, None]
    assert (top["inter_pos"], top["union_pos"], top["inter_neg"], top["union_neg"]) == (3, 6, 2, 5)
    assert (top["pos_iou"], top["neg_iou"], top["miou"]) == (0.5, 0.4, pytest.approx(0.45))
    assert cube[1, None]["miou"] == 1.0 and cube[2, None]["miou"] == 0.125
    assert metrics.macro(df, "camera", F.col("t") == 1, F.col("p") == 1).first()["macro_miou"] == 0.5625
    empty = spark.createDataFrame([(1, "day", 1, 1)], "camera int, cond string, t int, p int")
    assert metrics.cube(empty, ["camera"], F.col("t") == 1, F.col("p") == 1).first()["miou"] is None
    doc = metrics.report(metrics.cube(df, ["camera", "cond"], F.col("t") == 1, F.col("p") == 1), "camera", "cond").first()["report"]
    assert '"1"' in doc and '"night"' in doc


def test_boundary():
    full = np.ones((8, 8), bool)
    assert kernels.inner_boundary(full, 1).sum() == 28
    assert kernels.inner_boundary(~full, 1).sum() == 0
    a, b = np.zeros((32, 32), bool), np.zeros((32, 32), bool)
    a[:15], b[:18] = True, True
    x, y = kernels.inner_boundary(a, 1), kernels.inner_boundary(b, 1)
    assert 0 < (x & y).sum() < (x | y).sum()
    rng = np.random.default_rng(0)
    m = rng.random((20, 17)) < 0.8
    for d in (1, 2):
        pad = np.pad(m, d)
        slow = np.array([[m[i, j] and not pad[i : i + 2 * d + 1, j : j + 2 * d + 1].all() for j in range(17)] for i in range(20)])
        assert (kernels.inner_boundary(m, d) == slow).all()


def test_decisions(spark):
    df = spark.createDataFrame([(.8, .1), (.1, .5), (.55, .4), (.3, .3)], "e double, i double")
    call, sure = scoring.decide(F.col("e"), F.col("i"))
    got = [(r[0], round(r[1], 9)) for r in df.select(call, sure).collect()]
    assert got == [("exterior", 1.0), ("interior", 0.7), ("unsure", 0.2), ("unsure", 0.2)]


def test_hours_and_nights(spark):
    names = ["9708_20110527_220521", "x_20110527_060000", "x_20110527_070000", "x_20110527_170000", "x_20110527_180000", "none"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [(r[0], r[1]) for r in df.select(text.hour_of(F.col("n")), text.is_night(text.hour_of(F.col("n")))).collect()]
    assert got == [(22, True), (6, True), (7, False), (17, False), (18, True), (None, False)]


def test_profile_counts_missing_in_the_denominator(spark):
    df = spark.createDataFrame([("c", v, i, -5.0) for i, v in enumerate(["1", "-999", "text", "3"])], "cam string, sunny string, i int, lat double")
    r = dataset.profile(df, "cam", ["sunny"], "lat", "i").first()
    assert (r["n"], r["sunny"], r["lat"]) == (4, 1.0, 5.0)


def test_weighted_quantile(spark):
    df = spark.createDataFrame([("k", 1.0, 1), ("k", 2.0, 1), ("k", 3.0, 2)], "k string, v double, w int")
    r = metrics.weighted_quantiles(df, ["k"], "v", "w", {"a": 0.5, "b": 0.9}).first()
    assert (r["a"], r["b"]) == (2.0, 3.0)


def test_tiles(spark):
    df = spark.createDataFrame([(144,), (192,), (64,)], "n int")
    assert [r[0] for r in df.select(geometry.tile_starts(F.col("n"), 96, 24)).collect()] == [[0, 48], [0, 72, 96], [0]]
    rng = np.random.default_rng(0)
    stack = rng.random((3, 64, 80)) * 0.2 + np.linspace(0.1, 0.8, 3)[:, None, None]
    assert (kernels.fuse_tiled(stack, 128, 16) == kernels.fuse(stack)).all()
    assert np.abs(kernels.fuse_tiled(stack, 32, 8) - kernels.fuse(stack)).mean() < 1e-9


def test_early_stop(spark):
    df = spark.createDataFrame([(1, .7951), (2, .7398), (3, .7710), (4, .7235)], "epoch int, miou double")
    got = dataset.early_stop(df, "epoch", "miou", 3).orderBy("epoch").collect()
    assert [r["streak"] for r in got] == [0, 1, 2, 3] and [r["stop"] for r in got] == [False] * 3 + [True] and got[-1]["best_at"] == 1


def test_splits(spark):
    ids = [str(i) for i in range(15)]
    s = dataset.shuffled_splits(ids, 0, 0.2, 0.2)
    assert [len(s[k]) for k in ("test", "val", "train")] == [3, 3, 9] and sorted(sum(s.values(), []), key=int) == ids
    df = spark.createDataFrame([(i,) for i in ids], "camera string")
    h = dataset.hashed_splits(df, "camera", 0, 0.2, 0.2)
    assert {r["split"]: r["count"] for r in h.groupBy("split").count().collect()} == {"test": 3, "val": 3, "train": 9}
    two = h.unionByName(h.filter("split = 'test'").limit(1).withColumn("split", F.lit("val")))
    assert verify.leaks(two, "camera", "split").count() == 1
    assert verify.exact_cover(two, df, "camera").first()["repeated"] == 1


def test_farthest_points(spark):
    pts = [(0, 0., 0.), (1, 10., 0.), (2, 0., 10.), (3, 10., 10.), (4, 5., 5.)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = {r["id"]: r["pick"] for r in dataset.farthest_points(df, "id", ["x", "y"], 3).collect()}
    assert got == {4: 1, 0: 2, 1: 3} or got == {4: 1, 0: 2, 3: 3}
    assert dataset.farthest_points(df.limit(0), "id", ["x", "y"], 3).count() == 0


def test_ledger(spark):
    log = spark.createDataFrame([(1, 1, None, "pending", "t"), (2, 2, None, "pending", "t"), (3, 1, "pending", "running", "t"), (4, 2, "pending", "failed", "t")], "run_id long, job_id long, old_status string, new_status string, timestamp string")
    after = ledger.append(log, ledger.recover(log, F.lit("u")).unionByName(ledger.retry(log, F.lit("u"))))
    assert {r["job_id"]: (r["status"], r["n_runs"]) for r in ledger.current(after).collect()} == {1: ("pending", 3), 2: ("pending", 3)}
    assert {r["status"]: r["n"] for r in ledger.rollup(ledger.current(log)).collect()} == {"pending": 0, "running": 1, "complete": 0, "failed": 1}


def test_vanishing_point_and_crop():
    rng = np.random.default_rng(3)
    vp = np.array([0.2, 4.0])
    a = rng.uniform(-1, 1, (40, 2))
    b = a + (vp - a) * rng.uniform(0.05, 0.2, (40, 1))
    noise = rng.uniform(-1, 1, (12, 4))
    p, inside = kernels.vanishing_point(np.vstack([np.hstack([a, b]), noise]))
    assert inside[:40].all() and np.allclose(p[:2] / p[2], vp, atol=1e-3)
    rotation, degrees = kernels.rotation_to_vertical(np.array([100.0, 1000.0, 0.0]), 1000.0)
    d = rotation @ (np.array([0.1, 1, 0]) / np.hypot(0.1, 1))
    assert np.allclose(d, [0, 1, 0]) and degrees == pytest.approx(np.degrees(np.arctan(0.1)), abs=1e-6)
    x, y, half = kernels.inscribed_rectangle(np.array([[0, 0], [4, 0], [4, 2], [0, 2]], float), 2.0)
    assert half == pytest.approx(2.0, abs=1e-6) and (x, y) == (pytest.approx(2.0, abs=1e-5), pytest.approx(1.0, abs=1e-5))
    assert kernels.vanishing_point(np.zeros((1, 4)))[0] is None


def test_vanishing_points_by_group(spark):
    rows = [(i % 2, float(j), 0.0, 5.0, 10.0) for i in range(2) for j in range(8)]
    df = spark.createDataFrame(rows, "image int, x1 double, y1 double, x2 double, y2 double")
    got = kernels.vanishing_points(df, "image").collect()
    assert {r["image"]: r["inliers"] for r in got} == {0: 8, 1: 8}


def test_color_matrix_and_curves(spark):
    m = color.wide_to_standard()
    assert [round(sum(r), 6) for r in m] == [1.0, 1.0, 1.0]
    df = spark.createDataFrame([(x / 10,) for x in range(11)], "x double")
    for r in df.select("x", color.decode(color.encode(F.col("x"))).alias("y")).collect():
        assert r["y"] == pytest.approx(r["x"], abs=1e-9)
    r = df.select(*[c.alias(n) for c, n in zip(color.apply_matrix(m, (F.lit(1.0),) * 3), "rgb")]).first()
    assert r["g"] == pytest.approx(1.0)
    assert df.select(numeric.clamp_snap(F.lit(1.234), 1, 3, 0.1)).first()[0] == 120


def test_colours():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [0, 0, 0], [128, 64, 64]]], np.uint8)
    assert images.to_hsv(rgb)[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 255], [0, 0, 0], [0, 128, 128]]
    lab = images.to_lab(np.array([[1.0, 1, 1], [0, 0, 0], [1, 0, 0]]))
    assert np.allclose(lab, [[100, 0, 0], [0, 0, 0], [53.24, 80.09, 67.20]], atol=0.02)


def test_surface_residual(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random(500), rng.random(500)
    v = 1 + 2 * x - y + 3 * x * x - 0.5 * y * y + x * y
    noise = rng.normal(0, 0.1, 500)
    rows = [("exact", *map(float, r)) for r in zip(x, y, v)] + [("noisy", *map(float, r)) for r in zip(x, y, v + noise)]
    got = {r["k"]: r["residual"] for r in images.surface_residual(spark.createDataFrame(rows, "k string, x double, y double, v double"), ["k"], "x", "y", "v").collect()}
    design = np.column_stack([np.ones(500), x, y, x * x, y * y, x * y])
    fit, *_ = np.linalg.lstsq(design, v + noise, rcond=None)
    assert got["exact"] < 1e-6 and got["noisy"] == pytest.approx(np.std(v + noise - design @ fit), abs=1e-6)


def test_top_region():
    g = np.full((20, 12), 0.8)
    g[8:] = 0.2
    g[4:6, 3] = 0.3
    g[2, :] += 0.01
    span, bottom = images.top_region(g, 0.02, 0.1)
    assert bottom[0] == 7 and bottom[3] == 3 and span.sum() == 11 * 8 + 4
    assert (images.top_region(np.ones((5, 5)), 0.02, 0.1)[1] == 4).all()


def test_distributed_fusion_equals_the_local_one(spark):
    rng = np.random.default_rng(1)
    stack = rng.random((3, 40, 50))
    df = spark.createDataFrame([(7, k, 40, 50, s.ravel().tolist()) for k, s in enumerate(stack)], "image int, k int, h int, w int, pixels array<double>")
    for tile, overlap in ((0, 4), (24, 4)):
        got = np.stack([r["pixels"] for r in images.fused(df, tile, overlap).orderBy("y").collect()])
        assert np.allclose(got, kernels.fuse_tiled(stack, tile or 64, overlap))
    with pytest.raises(ValueError):
        images.fused(df, 6, 4)
    m = spark.createDataFrame([(1, [0, 127, 128, 129, 255])], "id int, m array<int>")
    assert images.coverage(m, "id", "m").first()["coverage"] == 0.4


def test_records(spark):
    df = spark.createDataFrame([(i, "g", 50.0 + 5 * i, 0.0, 0.0) for i in range(3)], "id long, g string, l double, a double, b double")
    runs, rows = records.sync_records(df, "g", "id", F.lit(7).cast("long"), "t")
    assert runs.first()["n_images"] == 3 and '"l":55.0' in runs.first()["target"] and {r["run_id"] for r in rows.collect()} == {7}
    f = spark.createDataFrame([tuple([1] + [0.5] * len(scoring.FEATURES))], ["id", *scoring.FEATURES])
    r = records.classification_rows(f, "id", "t").first()
    assert r["call"] in ("exterior", "interior", "unsure") and '"kitchen"' in r["scores"] and r["true_label"] is None
    p = spark.createDataFrame([(1, 2.0, (3.0, 4.0))], "id int, gps double, meta struct<gps:double,iso:double>")
    assert records.without_private(p, ["gps", "meta.gps"]).first().asDict(True) == {"id": 1, "meta": {"iso": 4.0}}
    one = spark.createDataFrame([(["b", "a"], 10)], "s array<string>, n int")
    assert one.select(records.output_name(F.col("s"), "jpg"), records.batches_needed(F.col("n"), 4)).first()[:] == ("a-b.jpg", 3)
    e = spark.createDataFrame([("k", 2.0, 1.0, True), ("k", 2.2, 1.0, True), ("k", 9.0, 1.0, False), ("k", 2.4, 1.0, True)], "k string, w double, h double, i boolean")
    r = records.aspect_error(e, ["k"], F.col("w"), F.col("h"), F.lit(2.0), F.col("i")).first()
    assert r["judged"] == 3 and r["median_error"] == pytest.approx(10.0)
    for bad in (lambda: records.check_tiling(10, 6), lambda: records.check_fractions(0.6, 0.5), lambda: records.refuse_overwrite(["a"], "a")):
        with pytest.raises((ValueError, TypeError)):
            bad()


def test_replacing_and_equalising():
    rng = np.random.default_rng(0)
    image, fill = rng.integers(0, 256, (2, 30, 40, 3), np.uint8)
    none, full = np.zeros((30, 40), np.uint8), np.full((30, 40), 255, np.uint8)
    assert (kernels.replace_region(image, fill, none) == image).all() and (kernels.replace_region(image, fill, full) == fill).all()
    half = none.copy()
    half[:15] = 255
    out = kernels.replace_region(image, fill, half)
    assert (out[:8] == fill[:8]).all() and (out[-8:] == image[-8:]).all()
    flat = np.repeat(np.arange(100, 140, dtype=np.uint8)[None], 64, 0)
    wide = kernels.equalize(flat, 4.0)
    assert wide.shape == flat.shape and np.ptp(wide) > np.ptp(flat)


def test_exterior_score_reads_the_top_regions_edges(spark):
    record = dict.fromkeys(scoring.FEATURES, 0.0) | {"sky_area_frac": 0.3, "sky_top_coverage": 0.9, "sky_below_ratio": 1.2}
    rows = [(1, record | {"edge_density": 0.5}), (2, record | {"sky_edge_density": 0.5}), (3, record | {"sky_colour_support": 0.4, "green_bottom_frac": 0.3})]
    df = spark.createDataFrame([(k, *r.values()) for k, r in rows], ["id", *scoring.FEATURES])
    got = {r["id"]: r["exterior"] for r in scoring.classify(df).collect()}
    # A busy image leaves a smooth sky alone; edges inside the region cost 0.55 of the quality.
    assert got[1] == pytest.approx(0.8) and got[2] == pytest.approx(0.8 * (0.4 + 0.6 * 0.45))
    assert got[3] == pytest.approx(0.8 + 0.1 * 0.4 + 0.1)


def test_inscribed_rectangle_against_a_grid():
    rng = np.random.default_rng(4)
    for _ in range(5):
        quad = np.array([[0, 0], [6, 0], [6, 4], [0, 4]], float) + rng.uniform(-0.8, 0.8, (4, 2))
        x, y, half = kernels.inscribed_rectangle(quad, 1.5)
        along = np.roll(quad, -1, 0) - quad

        def inside(px, py):
            return (along[:, 0] * (py - quad[:, 1]) - along[:, 1] * (px - quad[:, 0]) >= -1e-5).all()

        corners = [(sx, sy) for sx in (-1, 1) for sy in (-1, 1)]
        fits = lambda cx, cy, a: all(inside(cx + sx * a, cy + sy * a / 1.5) for sx, sy in corners)
        assert fits(x, y, half)
        assert not any(fits(cx, cy, half + 0.02) for cx in np.linspace(0, 6, 61) for cy in np.linspace(0, 4, 41))
    assert kernels.inscribed_rectangle(np.array([[0, 0], [4, 0], [2, 3]], float), 1.0)[2] > 0


def test_rotation_turns_no_further_than_needed():
    for point in ([100.0, 1000.0, 0.0], [-30.0, -900.0, 0.2], [0.0, 500.0, 0.0], [400.0, 1.0, 1.0]):
        rotation, degrees = kernels.rotation_to_vertical(np.array(point), 800.0)
        d = np.array(point) / (800.0, 800.0, 1.0)
        d /= np.linalg.norm(d) * (-1 if d[1] < 0 else 1)
        assert np.allclose(rotation @ d, [0, 1, 0]) and np.linalg.det(rotation) == pytest.approx(1.0)
        assert np.degrees(np.arccos((np.trace(rotation) - 1) / 2)) == pytest.approx(degrees, abs=1e-5)
        assert degrees == pytest.approx(np.degrees(np.arccos(d[1])), abs=1e-5)


def test_tiles_in_both_forms(spark):
    for n in (64, 144, 168, 192):
        made = geometry.tiles(n, 96, 24)
        (starts,) = spark.range(1).select(geometry.tile_starts(F.lit(n), 96, 24)).first()
        assert starts == [a for a, _, _ in made] and made[-1][1] == n
        for a, b, w in made:
            (column,) = spark.range(1).select(geometry.feather(b - a, 24, F.lit(a > 0), F.lit(b < n))).first()
            assert np.allclose(column, w)


def test_whole_images_row_by_row(spark):
    rng = np.random.default_rng(2)
    h, w = 12, 16
    a, b, m = rng.integers(0, 256, (3, h, w, 3)), rng.integers(0, 256, (3, h, w, 3)), rng.integers(0, 256, (3, h, w))
    m[0], m[1] = 0, 255
    rows = [(i, h, w, a[i].ravel().tolist(), b[i].ravel().tolist(), m[i].ravel().tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, h int, w int, image array<int>, fill array<int>, probability array<int>")
    got = {r["id"]: np.array(r["image"]).reshape(h, w, 3) for r in images.composited(df).collect()}
    assert (got[0] == a[0]).all() and (got[1] == b[1]).all()
    assert (got[2] == kernels.replace_region(a[2].astype(np.uint8), b[2].astype(np.uint8), m[2].astype(np.uint8))).all()
    gray = images.equalized(df.select("id", "h", "w", "probability"), "probability").collect()
    assert all((np.array(r["probability"]) == kernels.equalize(m[r["id"]].astype(np.uint8)).ravel()).all() for r in gray)
    shade = images.predicted(df, lambda pdf: [float(np.mean(x)) for x in pdf["image"]], "shade", "double").collect()
    assert [r["shade"] for r in sorted(shade, key=lambda r: r["id"])] == pytest.approx([x.mean() for x in a])
    pairs = df.select("id", "h", "w", "image", F.col("probability").alias("mask"))
    flipped = images.transformed(pairs, lambda x, y: (x[:, ::-1], y[:, ::-1])).collect()
    assert all((np.array(r["mask"]).reshape(h, w) == m[r["id"]][:, ::-1]).all() for r in flipped)
    assert all((np.array(r["image"]).reshape(h, w, 3) == a[r["id"]][:, ::-1]).all() for r in flipped)


def test_hsv_in_both_forms(spark):
    rng = np.random.default_rng(5)
    rgb = np.vstack([rng.integers(0, 256, (200, 3)), [[0, 0, 0], [255, 255, 255], [9, 9, 9], [255, 0, 0], [0, 255, 0], [0, 0, 255]]])
    df = spark.createDataFrame([tuple(map(int, x)) for x in rgb], "r int, g int, b int")
    got = df.select("r", "g", "b", *[c.alias(n) for n, c in images.hsv(F.col("r"), F.col("g"), F.col("b")).items()]).collect()
    want = images.to_hsv(np.array([[r["r"], r["g"], r["b"]] for r in got], np.uint8))
    assert (np.array([[r["h"], r["s"], r["v"]] for r in got]) == want).all()


def test_images_too_clipped_or_too_coloured_are_not_measured(spark):
    rows = [("a", 50.0, 1.0, 2.0)] * 8 + [("a", 99.0, 60.0, 60.0)] * 2 + [("b", 1.0, 0.0, 0.0)] * 19 + [("b", 40.0, 0.0, 0.0)]
    rows += [("c", 30.0 + i, 40.0 * i, 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "image string, l double, a double, b double")
    got = {r["image"]: r for r in normalize.measure(df, "image", neutral=0.3).collect()}
    assert (got["a"]["l"], got["a"]["a"], got["a"]["b"], got["a"]["valid_share"], got["a"]["neutral_share"]) == (50.0, 1.0, 2.0, 0.8, 1.0)
    assert got["b"]["l"] is None and got["b"]["a"] is None and got["b"]["neutral_share"] == 0.0
    assert got["c"]["l"] == 34.5 and got["c"]["a"] is None and got["c"]["neutral_share"] < 0.3


def test_boundaries_in_both_forms(spark, monkeypatch):
    rng = np.random.default_rng(6)
    h, w = 9, 12
    rows = [(i % 3, *[(rng.random(h * w) < 0.85).astype(int).tolist() for _ in range(2)]) for i in range(20)]
    rows += [(4, [1] * (h * w), [0] * (h * w))]
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>")
    for d in (1, 2):
        flags = df.select("a", kernels.boundary_flags(F.col("a"), h, w, d).alias("f")).collect()
        assert all((np.array(r["f"]).reshape(h, w) == kernels.inner_boundary(np.array(r["a"]).reshape(h, w).astype(bool), d)).all() for r in flags)
        share = d / np.hypot(h, w)
        assert kernels.boundary_width(h, w, share) == d
        native = sorted(map(tuple, kernels.boundary_counts(df, ["k"], "a", "b", h, w, share).collect()))
        monkeypatch.setattr(kernels, "NARROW", 0)
        assert native == sorted(map(tuple, kernels.boundary_counts(df, ["k"], "a", "b", h, w, share).collect()))
        monkeypatch.setattr(kernels, "NARROW", 2)
