"""Invariants, edge cases and comparisons with short NumPy definitions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.functions.expr import draw, hsv_to_rgb, normal, rgb_to_hsv
from pointloom.operators import cluster, crops, curve, losses, metrics, series, spatial, transforms as t, voxel

SCHEMA = "scene long, point_idx long, x double, y double, z double, segment long, instance long"


def cloud(spark, points, schema=SCHEMA):
    return spark.createDataFrame([(p + (0, 0))[:7] for p in points], schema)


def random_cloud(spark, n=200, scenes=2, seed=1):
    rng = np.random.default_rng(seed)
    return cloud(spark, [(int(i % scenes), int(i), *map(float, rng.uniform(-1, 1, 3)), int(rng.integers(-1, 3)), int(rng.integers(0, 5))) for i in range(n)])


@pytest.fixture(scope="module")
def edges(spark):
    """A scene with one point, one of equal points, and one with ties at equal distances."""
    return cloud(spark, [(0, 0, 1.0, 2.0, 3.0), *((1, i, 0.5, 0.5, 0.5) for i in range(4)), (2, 0, 0.0, 0.0, 0.0), (2, 1, 1.0, 0.0, 0.0), (2, 2, -1.0, 0.0, 0.0), (2, 3, 0.0, 1.0, 0.0)])


def brute_knn(df, k):
    p = df.toPandas()
    out = set()
    for s, g in p.groupby("scene"):
        for a in g.itertuples():
            d = sorted((((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), b.point_idx) for b in g.itertuples())
            out |= {(s, a.point_idx, r, i + 1) for i, (_, r) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("start", [0.01, 0.3, 5.0])
def test_knn_is_exact_for_any_first_cell(spark, start):
    df = random_cloud(spark, 120)
    got = {(r.scene, r.q, r.r, r["rank"]) for r in spatial.knn(df, df, 5, start).collect()}
    assert got == brute_knn(df, 5)


def test_knn_edges(spark, edges):
    got = {(r.scene, r.q, r.r, r["rank"]) for r in spatial.knn(edges, edges, 3, 0.5).collect()}
    assert got == brute_knn(edges, 3)
    padded = spatial.with_padding(spatial.knn(edges, edges, 3, 0.5), edges, 3).where("scene = 0").orderBy("rank").collect()
    assert [(r.r, r.d) for r in padded] == [(0, 0.0), (-1, 1e5), (-1, 1e5)]


def test_far_queries_find_their_scene(spark):
    refs = cloud(spark, [(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0)])
    far = cloud(spark, [(0, 7, 500.0, 0.0, 0.0)])
    assert [(r.r, r["rank"]) for r in spatial.knn(far, refs, 1, 0.5).collect()] == [(1, 1)]


def test_ball_query_takes_an_even_pick(spark):
    line = cloud(spark, [(0, i, i * 0.01, 0.0, 0.0) for i in range(11)])
    got = sorted((r.slot, r.r) for r in spatial.ball_query(line, line, 1.0, 4).where("q = 0").collect())
    assert got == [(i, int(11 / 4 * i)) for i in range(4)]


def test_interpolation_of_a_reference_is_its_value(spark):
    df = random_cloud(spark, 60).withColumn("v", F.col("x") * 2)
    p = spatial.interpolate(df, df, "v", 3, 0.3).join(df.select("scene", F.col("point_idx").alias("q"), F.col("v").alias("own")), ["scene", "q"])
    assert p.where(F.abs(F.col("v") - F.col("own")) > 1e-6).count() == 0


def test_farthest_points(spark):
    line = cloud(spark, [(0, i, float(i), 0.0, 0.0) for i in range(9)])
    assert [r.point_idx for r in spatial.farthest_points(line, 3).orderBy("step").collect()] == [0, 8, 4]


def test_components_are_label_pure_and_complete(spark):
    df = random_cloud(spark, 150, 1)
    got = cluster.components(df, spatial.radius_pairs(df, df, 0.4)).toPandas()
    p = df.toPandas().set_index("point_idx")
    assert len(got) == 150
    for _, g in got.groupby("root"):
        assert p.loc[g.point_idx, "segment"].nunique() == 1 and g["size"].iloc[0] == len(g)
    root = got.set_index("point_idx").root
    for a in p.itertuples():
        for b in p.itertuples():
            if a.segment == b.segment and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 0.16:
                assert root[a.Index] == root[b.Index]


def test_components_without_pairs(spark, edges):
    none = spark.createDataFrame([], "scene long, q long, r long, d2 double")
    c = cluster.components(edges, none)
    assert c.where("root = point_idx AND size = 1").count() == edges.count()


def test_fragments_cover_all_points(spark):
    df = random_cloud(spark, 100)
    f = voxel.fragments(df, 0.7)
    assert f.select("scene", "point_idx").distinct().count() == 100
    per = f.groupBy("scene", "fragment").agg(F.count("*").alias("n")).join(f.groupBy("scene").agg(F.countDistinct("gx", "gy", "gz").alias("v")), "scene")
    assert per.where("n <> v").count() == 0


def test_voxels_of_edges(spark, edges):
    v = {(r.scene, r.n) for r in voxel.downsample(edges, 0.3).where("scene < 2").collect()}
    assert v == {(0, 1), (1, 4)}
    empty = edges.where("false")
    assert voxel.downsample(empty, 0.3).count() == 0 and voxel.fragments(empty, 0.3).count() == 0


def test_unpooling_adds_the_parent(spark):
    df = voxel.cells(random_cloud(spark, 50).withColumn("feat", F.array_repeat(F.lit(1.0), 8)), 0.2)
    out = voxel.grid_unpool(df, voxel.grid_pool(df, 2), 2)
    assert out.count() == 50 and out.where("feat[0] <> 2").count() == 0


def test_mixed_instances_do_not_collide(spark):
    df = random_cloud(spark, 90, 3)
    m = voxel.mix_scenes(df).groupBy("mix_id", "instance").agg(F.countDistinct("scene").alias("n"))
    assert m.where("n > 1").count() == 0
    assert {r.mix_id for r in voxel.mix_scenes(df).select("mix_id").distinct().collect()} == {0, 2}


def test_rotation_keeps_distances(spark):
    df = random_cloud(spark, 40, 1)
    r = t.rotate(df, 1.1, "x").toPandas().set_index("point_idx")
    p = df.toPandas().set_index("point_idx")
    d = lambda q, i, j: math.dist(q.loc[i, ["x", "y", "z"]], q.loc[j, ["x", "y", "z"]])
    assert all(abs(d(p, i, i + 1) - d(r, i, i + 1)) < 1e-9 for i in range(39))


def test_scene_transforms_of_edges(spark, edges):
    one = t.normalize_coord(edges).where("scene < 2")
    assert one.where("x is not null and x <> 0").count() == 0
    same = edges.withColumns({"r": F.lit(9.0), "g": F.lit(9.0), "b": F.lit(9.0)})
    assert t.auto_contrast(same).where("r <> 9").count() == 0
    assert t.min_max(edges, ["x"]).where("scene = 1 and x <> 0").count() == 0


def test_hsv_round_trip(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.uniform(0, 1, (200, 3))] + [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.5, 0.5, 0.5)], "r double, g double, b double")
    back = hsv_to_rgb(*rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")))
    bad = sum((F.abs(c - F.col(k)) > 1e-9).cast("int") for c, k in zip(back, "rgb"))
    assert df.where(bad > 0).count() == 0


def test_draws_do_not_depend_on_partitions(spark):
    df = random_cloud(spark, 500)
    a = {(r.scene, r.point_idx): r.u for r in df.repartition(2).withColumn("u", draw("s")).collect()}
    b = {(r.scene, r.point_idx): r.u for r in df.repartition(7).withColumn("u", draw("s")).collect()}
    assert a == b and 0.4 < np.mean(list(a.values())) < 0.6
    n = [r.n for r in df.select(normal("s").alias("n")).collect()]
    assert abs(np.mean(n)) < 0.2 and 0.85 < np.std(n) < 1.15


def test_views_and_blocks(spark):
    df = random_cloud(spark, 300, 1)
    v = crops.multi_view(df, 2, 3)
    assert {(r.kind, r.view) for r in v.select("kind", "view").distinct().collect()} == {("global", 0), ("global", 1), ("local", 0), ("local", 1), ("local", 2)}
    b = crops.multi_block(df, 3, overlap=False)
    assert b.count() == b.select("point_idx").distinct().count()
    e = crops.multi_block(df, 3, early_fuse=True)
    assert e.where("is_target = 0").groupBy("block").count().select("count").distinct().count() == 1


def test_finite_guard(spark):
    bad = cloud(spark, [(0, 0, float("nan"), 0.0, 0.0)])
    with pytest.raises(Exception, match="not finite"):
        crops.assert_finite(bad).collect()
    assert crops.assert_finite(cloud(spark, [(0, 0, 1.0, 0.0, 0.0)])).count() == 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 65535)] * 3), min_size=1, max_size=40))
def test_hilbert_round_trip(cells):
    a = np.array(cells)
    code = curve.hilbert_code(a[:, 0], a[:, 1], a[:, 2])
    assert (np.stack(curve.hilbert_cell(code), axis=1) == a).all()


def test_hilbert_steps_are_neighbours():
    cells = np.stack(curve.hilbert_cell(np.arange(512), 3), axis=1)
    assert (np.abs(np.diff(cells, axis=0)).sum(axis=1) == 1).all() and len({tuple(c) for c in cells}) == 512


def test_morton_of_all_bits(spark):
    df = spark.createDataFrame([(65535, 65535, 65535), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)], "gx long, gy long, gz long")
    codes = [r.code for r in curve.encode(df, "z").collect()]
    assert codes == [2**48 - 1, 4, 2, 1, 0]
    assert curve.decode(curve.encode(df, "z-trans"), "z-trans").subtract(df.withColumn("code", F.lit(0))).count() <= 5


def test_small_scenes_are_one_patch(spark):
    df = voxel.cells(random_cloud(spark, 30), 0.1)
    p = curve.patches(curve.serialize(df), 64)
    assert p.where("borrowed or patch > 0").count() == 0
    q = curve.patches(curve.serialize(df), 8).groupBy("scene", "patch").count()
    assert q.where("count <> 8").count() == 0


def test_metrics_of_absent_and_ignored_classes(spark):
    d = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 1), (0, 2, -1, 1)], "scene long, point_idx long, target long, pred long")
    a = metrics.all_metrics(d, 3).first()
    assert abs(a.oa - 0.5) < 1e-9 and abs(a.miou - (0.5 + 0.0) / 2) < 1e-6
    assert abs(metrics.dense_metrics(d, 4).first().miou - 0.125) < 1e-6
    none = d.where("target < 0")
    assert metrics.confusion(none, 3).count() == 0 and metrics.all_metrics(none, 3).first().miou is None


def test_average_precision(spark):
    gt = spark.createDataFrame([(0, i, i // 10, 0) for i in range(20)], "scene long, point_idx long, instance long, class long")
    pred = spark.createDataFrame([(0, i, i // 10, 0) for i in range(20)], "scene long, point_idx long, proposal long, class long")
    props = spark.createDataFrame([(0, 0, 0, 10, 0.9, 0), (0, 1, 0, 10, 0.8, 0)], "scene long, proposal long, class long, n long, score double, void long")
    truth = spark.createDataFrame([(0, 0, 0, 10), (0, 1, 0, 10), (0, 2, 1, 10)], "scene long, instance long, class long, n long")
    got = {(r["class"], r.iou): r.ap for r in metrics.average_precision(metrics.match_instances(gt, pred, 5), truth, props).collect()}
    assert abs(got[(0, 0.5)] - 1.0) < 1e-9 and got[(1, 0.5)] == 0.0


def test_losses_of_a_sure_prediction(spark):
    rows = [(0, i, 0, c, 50.0 if c == 0 else -50.0) for i in range(3) for c in range(2)]
    d = spark.createDataFrame(rows, "scene long, point_idx long, target long, class long, logit double")
    k = ["scene", "point_idx"]
    assert losses.cross_entropy(d, k).first().loss < 1e-9
    assert losses.lovasz_softmax(d, k).first().loss < 1e-9
    assert losses.focal(d, k, 2).first().loss < 1e-9
    even = d.withColumn("logit", F.lit(0.0))
    assert abs(losses.cross_entropy(even, k, smoothing=0.3).first().loss - math.log(2)) < 1e-9


def test_rope_keeps_norms_and_turns_back(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 3, 5, 7)], "f array<double>, a long, b long, c long")
    g = [F.col(c) for c in "abc"]
    there = df.withColumn("f2", losses.rope(F.col("f"), *g, dim=6))
    back = there.select("f", losses.rope(F.col("f2"), *g, dim=6, inverse=True).alias("f3")).first()
    assert np.allclose(back.f, back.f3)


def test_schedules_meet_their_ends(spark):
    lr = [r.lr for r in series.steps(spark, 100).select(series.one_cycle(100, 1.0).alias("lr")).collect()]
    assert abs(max(lr) - 1.0) < 1e-3 and abs(lr[0] - 0.04) < 1e-9 and abs(lr[-1] - 4e-6) < 1e-9
    w = [r.lr for r in series.steps(spark, 100).select(series.cosine_warmup(80, 1.0, 0.1, 10, 0.0, 5).alias("lr")).collect()]
    assert w[:5] == [0.0] * 5 and abs(w[14] - 1.0) < 1e-9 and w[-1] == 0.1


def test_interleave_restarts_short_sources(spark):
    a = spark.range(6).withColumnRenamed("id", "k")
    b = spark.range(100, 102).withColumnRenamed("id", "k")
    got = [(r.slot, r.k) for r in series.interleave([a, b], [2, 1], "k").orderBy("slot").collect()]
    assert got == [(0, 0), (1, 1), (2, 100), (3, 2), (4, 3), (5, 101), (6, 4), (7, 5), (8, 100)]


def test_align_pose_of_equal_poses_is_nothing(spark):
    pose = F.array(*(F.lit(v) for v in (0.0, -1.0, 0.0, 3.0, 1.0, 0.0, 0.0, 4.0, 0.0, 0.0, 1.0, 5.0, 0.0, 0.0, 0.0, 1.0)))
    df = random_cloud(spark, 20).withColumns({"pose": pose, "target_pose": pose, "ox": F.col("x")})
    assert t.align_pose(df).where(F.abs(F.col("x") - F.col("ox")) > 1e-9).count() == 0


def test_prefix_equals_a_window(spark):
    from pointloom.operators.scan import prefix

    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS k", "id % 13 AS v")
    got = prefix(df, "k", value="v").orderBy("k").collect()
    run = 0
    for i, r in enumerate(got):
        run += r.v
        assert (r.rank, r.running) == (i, run)
    assert prefix(df.where("false"), "k").count() == 0


def test_sensor_to_top_of_equal_frames_is_identity(spark):
    from pointloom.operators import relational

    q, s = [0.8, 0.1, -0.3, 0.5], [1.0, 2.0, 3.0]
    names = ["sensor", "ego", "top", "top_ego"]
    df = spark.createDataFrame([(1, *[q, s] * 4)], "id long, " + ", ".join(f"{n}_q array<double>, {n}_t array<double>" for n in names))
    r = relational.top_lidar_matrices(df).first()
    assert np.allclose(np.array(r.rotation).reshape(3, 3), np.eye(3)) and np.allclose(r.shift, 0)
    assert relational.top_lidar_matrices(df.where("false")).count() == 0


def test_range_images(spark):
    rows = [(0, 1, 0, [5.0, 0.0], [1.0, 9.0], [2.0, 9.0], [3.0, 9.0]), (0, 0, 1, [7.0, 8.0], [4.0, 5.0], [4.0, 5.0], [4.0, 5.0])]
    df = spark.createDataFrame(rows, "scene long, laser int, return_no int, ranges array<double>, xs array<double>, ys array<double>, zs array<double>")
    got = [(r.point_idx, r.x, r.segment) for r in t.range_image_points(df).orderBy("point_idx").collect()]
    assert got == [(0, 1.0, 0), (1, 4.0, 0), (2, 5.0, 0)]
    labeled = t.range_image_points(df.withColumn("labels", F.array(F.lit(3), F.lit(4))))
    assert [r.segment for r in labeled.orderBy("point_idx").collect()] == [3, 3, 4]


def test_external_labels_join_by_position(spark, edges):
    v = spark.createDataFrame([(1, 0, 7), (1, 3, 9)], "scene long, position long, value long")
    got = {(r.scene, r.point_idx): r.part for r in t.attach_by_position(edges, v, "part").collect()}
    assert got[(1, 0)] == 7 and got[(1, 3)] == 9 and got[(0, 0)] is None and len(got) == edges.count()


def test_multi_views_cover_what_they_say(spark):
    """Local views lie around points of the major view, and a new one starts where no earlier one lies while there is such a place."""
    df = random_cloud(spark, 200, 1, seed=4)
    v = crops.multi_view(df, 1, 4, local_scale=(0.05, 0.1)).toPandas()
    major = set(v[v.kind == "global"].point_idx)
    seen: set = set()
    for i in range(4):
        local = v[(v.kind == "local") & (v.view == i)].sort_values("rank")
        start = int(local.point_idx.iloc[0])
        assert start in major and (start not in seen or major <= seen)
        seen |= set(local.point_idx)


def test_color_jitter_orders_and_bounds(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 3, i, *map(float, rng.uniform(0, 255, 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "scene long, point_idx long, r double, g double, b double")
    outs = []
    for order in (0, 7, 23):
        out = t.color_jitter(df, order=order).toPandas().sort_values("point_idx")[["r", "g", "b"]].to_numpy()
        assert (out >= -1e-9).all() and (out <= 255 + 1e-9).all()
        outs.append(out)
    assert not np.allclose(outs[0], outs[2])
    still = t.color_jitter(df, strength=(0.0, 0.0, 0.0, 0.0)).toPandas().sort_values("point_idx")[["r", "g", "b"]].to_numpy()
    assert np.allclose(still, df.toPandas().sort_values("point_idx")[["r", "g", "b"]].to_numpy())


def test_farthest_points_against_a_loop(spark):
    df = random_cloud(spark, 80, 2, seed=9)
    got = spatial.farthest_points(df, 10).toPandas()
    for s, g in df.toPandas().groupby("scene"):
        g = g.sort_values("point_idx")
        p, ids = g[["x", "y", "z"]].to_numpy(), g.point_idx.to_list()
        chosen = [0]
        while len(chosen) < 10:
            chosen.append(int(np.argmax([min(((p[i] - p[c]) ** 2).sum() for c in chosen) for i in range(len(p))])))
        assert got[got.scene == s].sort_values("step").point_idx.to_list() == [ids[c] for c in chosen]


def test_hilbert_column_equals_the_function(spark):
    df = voxel.cells(random_cloud(spark, 50), 0.1)
    p = curve.encode(df, "hilbert").toPandas()
    assert (p.code.to_numpy() == curve.hilbert_code(p.gx, p.gy, p.gz)).all()
    q = curve.encode(df, "hilbert-trans").toPandas()
    assert (q.code.to_numpy() == curve.hilbert_code(q.gy, q.gx, q.gz)).all()


def test_targets_are_changed_each_by_itself(spark):
    from pointloom.operators import crops

    rows = [(s, i, float(i % 7), float(i % 5), float(i % 3)) for s in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "scene long, point_idx long, x double, y double, z double")
    blocks = crops.multi_block(df, 2, (0.2, 0.3), early_fuse=True)
    table = crops.drawn_augments(blocks)
    assert table.count() == 2 * 2 * 2 and len({(r.turn, r.scale) for r in table.collect()}) == 8
    got = crops.augmented_blocks(blocks, table, {"sigma": 0.0}).collect()
    assert len(got) == blocks.count()
    draws = {(r.scene, r.block, r["copy"]): r for r in table.collect()}
    for key in {(r.scene, r.block) for r in got}:
        mine = [r for r in got if (r.scene, r.block) == key]
        for copy in ("student", "teacher"):
            # Turns and mirrors keep distances up to the scale that was drawn.
            a, b = mine[0], mine[-1]
            before = math.dist((a.x, a.y, a.z), (b.x, b.y, b.z))
            assert math.isclose(math.dist(a[copy], b[copy]), before * draws[(*key, copy)].scale, abs_tol=1e-9)
        assert any(math.dist(r.student, r.teacher) > 1e-3 for r in mine)
    shared = {}
    for r in got:
        shared.setdefault((r.scene, r.point_idx), set()).add(tuple(r.student))
    assert any(len(v) == 2 for v in shared.values())  # a context point that both targets of a scene have
    alone = crops.augmented_blocks(blocks, table.where("copy = 'student'")).select("student", "teacher").collect()
    assert all(r.student is not None and r.teacher is None for r in alone)
