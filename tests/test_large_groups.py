"""Ranks, selections and farthest points in groups of any size, against plain sorting."""

from __future__ import annotations

import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pointloom.functions.shared import shared_dir
from pointloom.operators import cluster, crops, curve, scan, spatial
from pointloom.plans import scene_queries  # noqa: F401


def rows_of(rng, sizes, values):
    return [(g, i, float(rng.choice(values))) for g, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("most", [0, 40, 10**9])
def test_ranks_within_groups(spark, most):
    rng = random.Random(1)
    rows = rows_of(rng, [1, 5, 60, 200, 8], range(9))
    df = spark.createDataFrame(rows, "g long, i long, v double").repartition(6)
    got = {(r.g, r.i): r["rank"] for r in scan.rank_within(df, ["g"], "v", F.desc("i"), most=most).collect()}
    for g in range(5):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], -r[1]))
        assert [got[g, i] for _, i, _ in order] == list(range(len(order)))
    assert scan.rank_within(df.where("false"), ["g"], "v", most=most).count() == 0


@pytest.mark.parametrize("most", [6, 10**9])
@pytest.mark.parametrize("values", [[0.0, 1.0], [10.0**x for x in range(-300, 300, 7)]])
def test_least_of_each_group(spark, most, values):
    """Ties, one value alone, and values over many powers of ten, by few quantiles."""
    rng = random.Random(2)
    rows = rows_of(rng, [1, 9, 120, 300], values)
    df = spark.createDataFrame(rows, "g long, i long, v double").repartition(5).withColumn("k", F.when(F.col("g") == 1, 0).when(F.col("g") == 2, 50).when(F.col("g") == 3, 999).otherwise(1))
    got = {(r.g, r.i) for r in scan.least(df, ["g"], "v", "i", "k", parts=4, most=most).collect()}
    want = {x[:2] for g, k in enumerate([1, 0, 50, 999]) for x in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))[:k]}
    assert got == want
    marked = scan.among_least(df, ["g"], "v", "i", "k", "m", parts=4, most=most)
    assert marked.count() == len(rows) and {(r.g, r.i) for r in marked.where("m").collect()} == want


def brute_farthest(points, m):
    at, d, out = 0, [float("inf")] * len(points), []
    for _ in range(min(m, len(points))):
        out.append(points[at][0])
        c = points[at]
        d = [min(x, (p[1] - c[1]) ** 2 + (p[2] - c[2]) ** 2 + (p[3] - c[3]) ** 2) for x, p in zip(d, points)]
        at = max(range(len(points)), key=lambda i: (d[i], -i))
    return out


def clouds():
    rng = random.Random(5)
    draw = lambda n, f: [(3 * i + 1, *f()) for i in range(n)]
    return {
        "noise": draw(400, lambda: [rng.random() for _ in range(3)]),
        "grid": draw(300, lambda: [float(rng.randrange(4)) for _ in range(3)]),  # ties and points that coincide
        "line": draw(150, lambda: [float(rng.randrange(60)), 0.0, 0.0]),
        "one": draw(20, lambda: [2.0, 2.0, 2.0]),
        "alone": draw(1, lambda: [1.0, 2.0, 3.0]),
    }


@pytest.mark.parametrize("m", [1, 8])
def test_farthest_points_by_cells(spark, m):
    sets = clouds()
    rows = [(s, *p) for s, name in enumerate(sets) for p in sets[name]]
    df = spark.createDataFrame(rows, "scene long, point_idx long, x double, y double, z double").repartition(5)
    want = {(s, k): i for s, name in enumerate(sets) for k, i in enumerate(brute_farthest(sets[name], m))}
    for most in (0,):
        assert {(r.scene, r.step): r.point_idx for r in spatial.farthest_points(df, m, most).collect()} == want
    assert spatial.farthest_points(df.where("false"), m, 0).count() == 0


def test_rounds_make_many_picks(spark, monkeypatch):
    """Cells decide more than one pick a round, and a bound on a round's picks changes nothing."""
    real = spatial._picked
    import pandas as pd

    rng = random.Random(7)
    cells = pd.DataFrame([{"point_idx": i, "d": rng.random() + 5, "n": 3, "low": i, **{c: 10.0 * (i // 9**j % 9) for j, c in enumerate("xyz")}} for i in range(100)])
    for c in "xyz":
        cells["l" + c] = cells["h" + c] = cells[c]
    calls = real(cells, 50)
    assert len(calls) == 50 and calls[0] == int(cells["d"].to_numpy().argmax())
    monkeypatch.setattr(spatial, "PICKS_A_ROUND", 2)
    points = clouds()["noise"][:60]
    df = spark.createDataFrame([(0, *p) for p in points], "scene long, point_idx long, x double, y double, z double")
    assert [r.point_idx for r in spatial.farthest_points(df, 4, 0).orderBy("step").collect()] == brute_farthest(points, 4)


def test_cells_beyond_the_bits_are_an_error(spark):
    at = lambda x: spark.createDataFrame([(0, 0, x, 0, 5)], "scene long, point_idx long, gx long, gy long, gz long")
    assert curve.encode(at(65535)).count() == 1 and curve.encode(at(3), bits=3).collect()
    for bad, bits, orders in ((65536, 16, ("z", "hilbert-trans")), (-1, 16, ("z",)), (8, 3, ("hilbert",))):
        for order in orders:
            with pytest.raises(Exception, match="bits"):
                curve.encode(at(bad), order, bits).collect()
    with pytest.raises(ValueError):
        curve.encode(at(0), bits=17)


def test_drawn_orders_are_a_permutation():
    assert sorted(curve.drawn_orders(curve.ORDERS, "s")) == sorted(curve.ORDERS)
    assert len({tuple(curve.drawn_orders(curve.ORDERS, str(i))) for i in range(60)}) > 10


def test_crops_do_not_depend_on_the_plan(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(s, i, rng.random(), float(rng.randrange(3)), 0.0) for s, n in ((0, 40), (1, 300)) for i in range(n)], "scene long, point_idx long, x double, y double, z double")
    got = [{(r.scene, r.point_idx) for r in crops.sphere_crop(df, 100, most=most).collect()} for most in (30, 10**9)]
    assert got[0] == got[1] and len(got[0]) == 140


def test_points_of_one_cell_and_index_keep_their_order_on_all_curves(spark):
    rng = random.Random(11)
    rows = [(s, rng.randrange(3), rng.randrange(2), rng.randrange(2), 0) for s in range(2) for _ in range(400)]
    df = spark.createDataFrame(rows, "scene long, point_idx long, gx long, gy long, gz long").repartition(7)
    for most in (0, 10**9):
        ranks = {}
        for r in curve.serialize(df, ("z", "z-trans", "hilbert"), most=most).collect():
            ranks.setdefault((r.scene, r.code_0, r.point_idx), []).append((r.rank_0, r.rank_1, r.rank_2))
        for of in ranks.values():
            assert all(sorted(x) == [x[0] + i for i in range(len(x))] for x in zip(*sorted(of)))


@pytest.mark.parametrize("copies", [1, 40])
def test_crop_with_two_points_in_the_middle(spark, tmp_path, copies):
    """The middle's point_idx belongs to points at both ends: the crop does not depend on the rows' order."""
    from pointloom.plans import QUERIES

    line = lambda order, x: (0, order, 0, 1, float(x), 0.0, 0.0, 0.0)
    n = 5 * copies
    rows = [line(o, o) for o in range(n)] + [line(n, 0), line(n, 100 * n)] + [line(n + 1 + o, n + 1 + o) for o in range(n)]
    got = []
    for i, r in enumerate((rows, rows[::-1])):
        df = spark.createDataFrame(r, "l_partkey long, l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
        df.coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        got.append(sorted(r.point_idx for r in QUERIES["scene_crop"](spark, f"{tmp_path}/{i}").collect()))
    assert got[0] == got[1] and len(got[0]) == (2 * n + 2) * 3 // 10


@pytest.mark.parametrize("k", [1, 6])
def test_knn_candidates_do_not_grow_with_density(spark, monkeypatch, k):
    """A crowd in a millionth of the first cell, many copies of one point, and a lone far point: right, and by few candidates a query."""
    rng = random.Random(3)
    p = [(0, i, *(rng.random() * 1e-2 for _ in range(3))) for i in range(400)] + [(0, i, 0.5, 0.5, 0.5) for i in range(400, 500)] + [(0, 500, 9.0, 0.0, 0.0)]
    p += [(1, i, *(float(rng.randrange(3)) for _ in range(3))) for i in range(40)]
    df = spark.createDataFrame(p, "scene long, point_idx long, x double, y double, z double").repartition(5)
    pairs, real = spark.sparkContext.accumulator(0), spatial.dist2
    tick = F.udf(lambda: pairs.add(1) or 0.0, "double").asNondeterministic()
    monkeypatch.setattr(spatial, "dist2", lambda *c: real(*c) + tick())
    got = sorted((r.scene, r.q, r["rank"], r.r) for r in spatial.knn(df, df, k, 1.0).collect())
    d2 = lambda a, b: sum((u - v) * (u - v) for u, v in zip(a[2:], b[2:]))
    want = [(a[0], a[1], i + 1, b[1]) for a in p for i, b in enumerate(sorted((b for b in p if b[0] == a[0]), key=lambda b: (d2(a, b), b[1]))[:k])]
    assert got == sorted(want)
    assert pairs.value < 60_000  # 400 * 400 by the first cell alone


def test_balls_make_no_rows_of_pairs(spark, monkeypatch):
    """An even pick and the first by draw, against brute force, with ties, copies, an inner radius and many tasks; distances are not rows."""
    rng = random.Random(4)
    p = [(0, i, *(rng.randrange(12) / 8 for _ in range(3))) for i in range(300)] + [(1, i, 0.01 * (i % 3), 0.0, -5.0) for i in range(60)] + [(1, 60, 1e3, 0.0, 0.0)]
    df = spark.createDataFrame(p, "scene long, point_idx long, x double, y double, z double").repartition(3)
    monkeypatch.setattr(spatial, "QUERIES_A_TASK", 50)
    monkeypatch.setattr(spatial, "DISTANCES_AT_ONCE", 1000)
    monkeypatch.setattr(spatial, "near_pairs", None)
    draws = {(r.scene, r.point_idx): r.u for r in df.select("scene", "point_idx", spatial.draw("s").alias("u")).collect()}
    d2 = lambda a, b: sum((u - v) * (u - v) for u, v in zip(a[2:], b[2:]))
    for n, inner in ((4, 0.2), (1000, 0.0)):
        even, drawn = [], []
        for a in p:
            near = [(d2(a, b), b[1]) for b in p if b[0] == a[0] and d2(a, b) < 0.5 * 0.5]
            kept = sorted(x for x in near if x[0] <= 1e-5 or x[0] >= inner * inner)
            even += [(*a[:2], kept[s * len(kept) // n if len(kept) > n else s][1], s) for s in range(min(n, len(kept)))]
            drawn += [(*a[:2], x[1], s) for s, x in enumerate(sorted(near, key=lambda x: (draws[a[0], x[1]], x[1]))[:n])]
        rows = lambda d: sorted((r.scene, r.q, r.r, r.slot) for r in d.collect())
        assert rows(spatial.ball_query(df, df, 0.5, n, inner)) == sorted(even)
        assert rows(spatial.random_ball(df, df, 0.5, n, "s")) == sorted(drawn)
    assert spatial.ball_query(df.where("false"), df, 0.5, 4).count() == spatial.random_ball(df, df.where("false"), 0.5, 4).count() == 0


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Views and ranges are dealt to as many tasks as their rows ask for, whatever bytes a shuffle has; results stay."""
    import os

    from pointloom.plans import QUERIES, point_queries, views  # noqa: F401

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the test tables are not here")
    names, rows = ("patches", "voxel_inverse", "fan_back", "scene_shuffle"), lambda d: sorted(map(str, d.collect()))
    want = {n: rows(QUERIES[n](spark, data)) for n in names}
    monkeypatch.setattr(scan, "ROWS_A_TASK", 500)
    assert views.points_li(spark, data).rdd.getNumPartitions() == 12
    assert scan.prefix(views.points_big(spark, data), "scene", "point_idx").select(F.spark_partition_id()).distinct().count() > 6
    for n in names:
        assert rows(QUERIES[n](spark, data)) == want[n]


def shapes():
    rng = random.Random(11)
    ball = lambda n, at, r: [tuple(at[c] + rng.uniform(-r, r) for c in range(3)) for _ in range(n)]
    shell = lambda n, r: [tuple(r * v / math.dist(d, (0, 0, 0)) for v in d) for d in ([rng.gauss(0, 1) for _ in range(3)] for _ in range(n))]
    return {
        "sparse": (ball(250, (0, 0, 0), 1), 0.2),
        "dense": (ball(250, (0, 0, 0), 1), 0.9),
        "lattice": ([(i * 0.1, j * 0.1, -k * 0.1) for i in range(7) for j in range(6) for k in range(5)], 0.1),  # apart by the radius, as far as doubles tell
        "copies": ([(0.3, 0.3, 0.3)] * 150 + [(0.3, 0.3, 0.9)] * 90 + ball(20, (0.3, 0.3, 0.6), 0.02), 0.32),
        "shells": (shell(150, 0.2) + shell(150, 1.19), 1.0),  # most pairs are nearly as far as the radius
        "line": ([(i * 0.0999 * (1 + 1e-3 * (i % 3)), 0.0, 0.0) for i in range(60)], 0.1),
        "far": ([(1e6 + i * 0.05, -1e6, 0.0) for i in range(40)], 0.05),
        "two": (ball(120, (0, 0, 0), 0.02) + ball(120, (0.07, 0.07, 0), 0.02), 0.0605),
    }


@pytest.mark.parametrize("at_once", [0, 1024])
@pytest.mark.parametrize("shape", sorted(shapes()))
def test_components_by_cells_are_those_of_pairs(spark, monkeypatch, shape, at_once):
    """Compared with all pairs, in one label and in several, where few points are compared one by one and where all are halved."""
    monkeypatch.setattr(cluster, "PAIRS_AT_ONCE", at_once)
    points, radius = shapes()[shape]
    rng = random.Random(3)
    p = [(s, i, *xyz, rng.randrange(4) if s else 0) for s in (0, 1) for i, xyz in enumerate(rng.sample(points, len(points)))]
    df = spark.createDataFrame(p, "scene long, point_idx long, x double, y double, z double, segment long")
    root = {r[:2]: r[:2] for r in p}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in p:
        for b in p:
            if a[:2] < b[:2] and a[0] == b[0] and a[5] == b[5] and sum((u - v) * (u - v) for u, v in zip(a[2:4], b[2:4])) + (a[4] - b[4]) * (a[4] - b[4]) < radius * radius:
                u, v = sorted((top(a[:2]), top(b[:2])))
                root[v] = u
    sizes = Counter(top(k) for k in root)
    want = sorted((*k, top(k)[1], sizes[top(k)]) for k in root if sizes[top(k)] >= 2)
    assert sorted(tuple(r) for r in cluster.radius_components(df, radius, 2).collect()) == want


def test_components_of_points_without_place_or_label(spark):
    odd = [None, float("nan"), float("inf"), float("-inf")]
    p = [(0, i, x, 0.0, 0.0, 1) for i, x in enumerate(odd * 2)] + [(0, 20 + i, 0.0, 0.0, 0.0, None) for i in range(3)] + [(0, 30, 0.0, 0.0, 0.0, 1), (0, 31, 0.0, 0.0, 0.0, 1)]
    df = spark.createDataFrame(p, "scene long, point_idx long, x double, y double, z double, segment long")
    rows = lambda d: {(r.point_idx, r.root, r["size"]) for r in d.collect()}
    assert rows(cluster.radius_components(df, 0.5)) == {(i, i, 1) for i in [*range(8), 20, 21, 22]} | {(30, 30, 2), (31, 30, 2)}
    assert rows(cluster.radius_components(df, 0.5, 2, None)) == {(i, 20, 5) for i in (20, 21, 22, 30, 31)}
    assert cluster.radius_components(df.where("false"), 0.5).count() == 0
    with pytest.raises(Exception, match="too large for this radius"):
        cluster.radius_components(spark.createDataFrame([(0, 0, 1e18, 0.0, 0.0, 1)], df.schema), 0.5).collect()


def test_clusters_write_no_pairs(spark):
    """What is saved between the steps grows with the points; pairs would be many times that."""
    rng = random.Random(7)
    p = [(0, i, i % 2 + rng.random() / 20, rng.random() / 20, rng.random() / 20, 1) for i in range(4000)]
    df = spark.createDataFrame(p, "scene long, point_idx long, x double, y double, z double, segment long")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    saved = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = saved()
    got = cluster.proposals(df, 0.1).select("root", "size").collect()
    assert sorted(map(tuple, got)) == [(0, 2000), (1, 2000)]
    assert saved() - before < 4_000_000
