"""Queries over neighbours, clusters, lookups, series and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import cluster, curve, losses, relational, series, spatial, voxel
from . import query
from .views import EMB, EMB_S, FR, LI, draw_sql, frames_ev, points_emb, points_emb_s, points_li, r6 as s6, table

XYZ = ("x", "y", "z")
_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def _pairs(size: float, view: str = "emb") -> str:
    """Pairs in neighbouring cells, by cells as well: brute force would be quadratic on whole tables."""
    cells = ", ".join(f"CAST(floor({c} / {size}::DOUBLE) AS BIGINT) AS c{c}" for c in XYZ)
    return f"""g AS MATERIALIZED (SELECT *, {cells} FROM {view}), o(ox, oy, oz) AS MATERIALIZED (SELECT i, j, k FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j), (VALUES (-1), (0), (1)) c(k)),
pairs AS MATERIALIZED (SELECT a.scene, a.point_idx AS q, b.point_idx AS r, {_D2} AS d2 FROM (SELECT g.*, cx + ox AS nx, cy + oy AS ny, cz + oz AS nz FROM g, o) a
    JOIN g b ON a.scene = b.scene AND a.nx = b.cx AND a.ny = b.cy AND a.nz = b.cz WHERE {_D2} < {size}::DOUBLE * {size}::DOUBLE)"""


_KNN = f"""ranked AS (SELECT a.scene, a.point_idx AS q, b.point_idx AS r, {_D2} AS d2, row_number() OVER (PARTITION BY a.scene, a.point_idx ORDER BY {_D2}, b.point_idx) AS rank FROM emb a JOIN emb b ON a.scene = b.scene),
knn AS MATERIALIZED (SELECT * FROM ranked WHERE rank <= {{k}})"""


@query("knn", f"WITH {EMB}, {_KNN.format(k=8)} SELECT scene, q, r, rank, {s6('sqrt(d2)')} AS d FROM knn")
def knn(spark, sf):
    p = points_emb(spark, sf)
    return spatial.knn(p, p, 8, 0.05).select("scene", "q", "r", F.col("rank").cast("long").alias("rank"), r6(F.sqrt("d2")).alias("d"))


@query("knn_by_scene", f"WITH {EMB_S}, {_KNN.format(k=5)} SELECT scene, q, r, rank FROM knn")
def knn_by_scene(spark, sf):
    p = points_emb_s(spark, sf)
    return spatial.knn(p, p, 5, 0.1).select("scene", "q", "r", F.col("rank").cast("long").alias("rank"))


@query("knn_padded", f"""WITH {EMB_S}, ranked AS (SELECT a.scene, a.point_idx AS q, b.point_idx AS r, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY a.scene, a.point_idx ORDER BY {_D2}, b.point_idx) AS rank FROM emb a JOIN emb b ON a.scene = b.scene AND a.segment = b.segment)
SELECT e.scene, e.point_idx AS q, CAST(k AS BIGINT) AS rank, coalesce(r, -1) AS r, {s6('coalesce(d, 100000)')} AS d FROM emb e CROSS JOIN generate_series(1, 24) s(k) LEFT JOIN ranked x ON x.scene = e.scene AND x.q = e.point_idx AND x.rank = k""")
def knn_padded(spark, sf):
    """Among points of one scene and label; those with fewer than 24 are filled up."""
    p = points_emb_s(spark, sf)
    of = p.withColumns({"was": F.col("scene"), "scene": F.col("scene") * 8 + F.col("segment") + 1})
    filled = spatial.with_padding(spatial.knn(of, of, 24, 0.1), of, 24)
    return filled.withColumn("scene", F.floor(F.col("scene") / 8)).select("scene", "q", F.col("rank").cast("long").alias("rank"), "r", r6("d").alias("d"))


@query("radius_pairs", f"WITH {EMB}, {_pairs(0.1)} SELECT scene, q, r, {s6('d2')} AS d2 FROM pairs")
def radius_pairs(spark, sf):
    p = points_emb(spark, sf)
    return spatial.radius_pairs(p, p, 0.1).select("scene", "q", "r", r6("d2").alias("d2"))


@query("ball_strided", f"""WITH {EMB}, {_pairs(0.15)}, f AS (SELECT *, row_number() OVER (PARTITION BY scene, q ORDER BY d2, r) - 1 AS rk, count(*) OVER (PARTITION BY scene, q) AS n FROM pairs WHERE d2 <= 1e-5 OR d2 >= 0.0004)
SELECT scene, q, r, rk AS slot FROM f WHERE n <= 8 UNION ALL SELECT scene, q, r, CAST(i AS BIGINT) FROM f, generate_series(0, 7) s(i) WHERE n > 8 AND rk = n * i // 8""")
def ball_strided(spark, sf):
    p = points_emb(spark, sf)
    return spatial.ball_query(p, p, 0.15, 8, 0.02).select("scene", "q", "r", "slot")


@query("random_ball", f"""WITH {EMB}, {_pairs(0.15)}, f AS (SELECT scene, q, r, row_number() OVER (PARTITION BY scene, q ORDER BY {draw_sql('ball', 'scene', 'r')}, r) - 1 AS slot FROM pairs) SELECT scene, q, r, slot FROM f WHERE slot < 4""")
def random_ball(spark, sf):
    p = points_emb(spark, sf)
    return spatial.random_ball(p, p, 0.15, 4).select("scene", "q", "r", "slot")


@query("dilated_knn", f"""WITH {EMB_S}, {_KNN.format(k=10)}, n AS (SELECT *, count(*) OVER (PARTITION BY scene, q) AS n FROM knn)
SELECT scene, q, r, CAST(i AS BIGINT) AS slot FROM n, generate_series(0, 3) s(i) WHERE rank - 1 = floor(CASE WHEN n >= 10 THEN 3.0 ELSE (n - 1) / 3.0 END * i)""")
def dilated_knn(spark, sf):
    p = points_emb_s(spark, sf)
    return spatial.dilated_knn(p, p, 4, 2, 0.1).select("scene", "q", "r", "slot")


@query("idw", f"""WITH {EMB_S}, few AS (SELECT * FROM emb SEMI JOIN (SELECT scene, min(point_idx) AS point_idx FROM emb GROUP BY scene, floor(x / 0.1::DOUBLE), floor(y / 0.1::DOUBLE), floor(z / 0.1::DOUBLE)) v USING (scene, point_idx)), ranked AS (SELECT a.scene, a.point_idx AS q, {_D2} AS d2, b.feat[1] AS v, row_number() OVER (PARTITION BY a.scene, a.point_idx ORDER BY {_D2}, b.point_idx) AS rank FROM emb a JOIN few b ON a.scene = b.scene)
SELECT scene, q, {s6('sum(v / (sqrt(d2) + 1e-8)) / sum(1 / (sqrt(d2) + 1e-8))')} AS v FROM ranked WHERE rank <= 3 GROUP BY scene, q""")
def idw(spark, sf):
    p = points_emb_s(spark, sf).withColumn("v", F.element_at("feat", 1))
    return spatial.interpolate(p, voxel.dedupe_lowest(p, 0.1), "v", 3, 0.1).select("scene", "q", r6("v").alias("v"))


@query("gather_rel", f"""WITH {EMB}, {_KNN.format(k=4)} SELECT k.scene, q, r, {s6('b.x - a.x')} AS rel_x, {s6('b.y - a.y')} AS rel_y, {s6('b.z - a.z')} AS rel_z, {s6('b.feat[2]')} AS f2 FROM knn k JOIN emb a ON a.point_idx = q JOIN emb b ON b.point_idx = r""")
def gather_rel(spark, sf):
    p = points_emb(spark, sf)
    g = spatial.group(spatial.knn(p, p, 4, 0.05), p, queries=p)
    return g.select("scene", "q", "r", *(r6(f"rel_{c}").alias(f"rel_{c}") for c in XYZ), r6(F.element_at("feat", 2)).alias("f2"))


@query("subtraction", f"WITH {EMB}, {_KNN.format(k=4)} SELECT k.scene, q, r, {s6('a.feat[1] - b.feat[1]')} AS d1, {s6('a.feat[8] - b.feat[8]')} AS d8 FROM knn k JOIN emb a ON a.point_idx = q JOIN emb b ON b.point_idx = r")
def subtraction(spark, sf):
    p = points_emb(spark, sf)
    s = spatial.subtract(spatial.knn(p, p, 4, 0.05), p, p)
    return s.select("scene", "q", "r", r6(F.element_at("diff", 1)).alias("d1"), r6(F.element_at("diff", 8)).alias("d8"))


@query("aggregation", f"""WITH {EMB}, {_KNN.format(k=4)} SELECT k.scene, q, CAST(c - 1 AS INT) AS channel, {s6('sum((b.feat[c] + rank) * (CASE WHEN (c - 1) % 2 = 0 THEN 1.0 ELSE 0.5 END) * (1 + d2))')} AS v
FROM knn k JOIN emb b ON b.point_idx = r, generate_series(1, 8) s(c) GROUP BY k.scene, q, c""")
def aggregation(spark, sf):
    p = points_emb(spark, sf)
    near = spatial.knn(p, p, 4, 0.05).withColumns({"w": F.array(1.0 + F.col("d2"), 0.5 * (1.0 + F.col("d2"))), "pos": F.array_repeat(F.col("rank").cast("double"), 8)})
    return spatial.aggregate(near, p, "w", "pos").select("scene", "q", "channel", r6("v").alias("v"))


_DOT = " + ".join(f"a.feat[{i}] * b.feat[{i}]" for i in range(1, 9))


@query("relation_scores", f"WITH {EMB}, {_KNN.format(k=4)} SELECT k.scene, q, r, {s6(_DOT)} AS score FROM knn k JOIN emb a ON a.point_idx = q JOIN emb b ON b.point_idx = r")
def relation_scores(spark, sf):
    p = points_emb(spark, sf)
    return spatial.relation(spatial.knn(p, p, 4, 0.05), p, p).select("scene", "q", "r", r6("score").alias("score"))


@query("scatter_fusion", f"WITH {EMB}, {_KNN.format(k=4)} SELECT k.scene, q, {s6('sum(exp(-d2) * b.feat[3])')} AS fused FROM knn k JOIN emb b ON b.point_idx = r GROUP BY k.scene, q")
def scatter_fusion(spark, sf):
    p = points_emb(spark, sf).withColumn("v", F.element_at("feat", 3))
    return spatial.fuse(spatial.knn(p, p, 4, 0.05), p, F.exp(-F.col("d2")), "v").select("scene", "q", r6("fused").alias("fused"))


@query("label_transfer", f"""WITH {EMB_S}, few AS (SELECT * FROM emb SEMI JOIN (SELECT scene, min(point_idx) AS point_idx FROM emb GROUP BY scene, floor(x / 0.1::DOUBLE), floor(y / 0.1::DOUBLE), floor(z / 0.1::DOUBLE)) v USING (scene, point_idx)), ranked AS (SELECT a.scene, a.point_idx, b.instance, row_number() OVER (PARTITION BY a.scene, a.point_idx ORDER BY {_D2}, b.point_idx) AS rank FROM emb a JOIN few b ON a.scene = b.scene)
SELECT scene, point_idx, instance FROM ranked WHERE rank = 1""")
def label_transfer(spark, sf):
    p = points_emb_s(spark, sf)
    return spatial.transfer_labels(p, voxel.dedupe_lowest(p, 0.1), "instance", 0.1)


@query("overlap_ratio", f"""WITH {EMB_S}, m AS (SELECT scene, floor(x / 0.1::DOUBLE) AS vx, floor(y / 0.1::DOUBLE) AS vy, floor(z / 0.1::DOUBLE) AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM emb GROUP BY 1, 2, 3, 4),
h AS (SELECT a.scene AS a, b.scene AS b, count(DISTINCT (a.vx, a.vy, a.vz)) AS k FROM m a JOIN m b ON a.scene <> b.scene AND {_D2} < 0.0225 GROUP BY 1, 2), n AS (SELECT scene, count(*) AS n FROM m GROUP BY 1)
SELECT least(a, b) AS a, greatest(a, b) AS b, {s6('max(k / n)')} AS ratio FROM h JOIN n ON n.scene = h.a GROUP BY 1, 2""")
def overlap_ratio(spark, sf):
    return spatial.overlap_ratios(points_emb_s(spark, sf), 0.1).select("a", "b", r6("ratio").alias("ratio"))


def _fps_sql(m: int) -> str:
    """Each step's distances and choice as a pair of tables: the first point, then always the farthest, the lower index of equals."""
    d2 = "(p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z)"
    parts = ["c0 AS MATERIALIZED (SELECT scene, point_idx, x, y, z, 0 AS step FROM emb QUALIFY row_number() OVER (PARTITION BY scene ORDER BY point_idx) = 1)", f"d0 AS MATERIALIZED (SELECT p.*, {d2} AS d FROM emb p JOIN c0 c USING (scene))"]
    for i in range(1, m):
        parts.append(f"c{i} AS MATERIALIZED (SELECT scene, point_idx, x, y, z, {i} AS step FROM d{i - 1} QUALIFY row_number() OVER (PARTITION BY scene ORDER BY d DESC, point_idx) = 1 AND count(*) OVER (PARTITION BY scene) > {i})")
        parts.append(f"d{i} AS MATERIALIZED (SELECT p.* REPLACE (least(p.d, {d2}) AS d) FROM d{i - 1} p JOIN c{i} c USING (scene))")
    return f"WITH {EMB_S}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT scene, point_idx, CAST(step AS BIGINT) AS step FROM c{i}" for i in range(m))


@query("fps", _fps_sql(16))
def fps(spark, sf):
    return spatial.farthest_points(points_emb_s(spark, sf), 16)


# Clusters

_ROOTS = """e AS (SELECT p.scene, q, r FROM pairs p JOIN {v} a ON a.scene = p.scene AND a.point_idx = q JOIN {v} b ON b.scene = p.scene AND b.point_idx = r WHERE a.segment = b.segment),
reach AS (SELECT scene, point_idx AS q, point_idx AS c FROM {v} UNION SELECT e.scene, e.r, reach.c FROM reach JOIN e ON e.scene = reach.scene AND e.q = reach.q),
roots AS (SELECT scene, q AS point_idx, min(c) AS root FROM reach GROUP BY 1, 2)"""


@query("components", f"WITH RECURSIVE {EMB}, {_pairs(0.1)}, {_ROOTS.format(v='emb')} SELECT scene, point_idx, root, count(*) OVER (PARTITION BY scene, root) AS size FROM roots QUALIFY size >= 2")
def components(spark, sf):
    return cluster.radius_components(points_emb(spark, sf), 0.1, 2)


@query("proposals", f"""WITH RECURSIVE {EMB_S}, v AS (SELECT * FROM emb WHERE segment <> -1), {_pairs(0.15, 'v')}, {_ROOTS.format(v='v')}
SELECT scene, root, any_value(segment) AS segment, count(*) AS size, {s6('avg(feat[1])')} AS score FROM roots JOIN v USING (scene, point_idx) GROUP BY scene, root HAVING count(*) > 3""")
def proposals(spark, sf):
    p = points_emb_s(spark, sf)
    return cluster.proposals(p, 0.15, score=F.element_at("feat", 1)).select("scene", "root", "segment", "size", r6("score").alias("score"))


@query("point_group", f"""WITH RECURSIVE {EMB_S}, shifted AS (SELECT scene, point_idx, segment, (x + avg(x) OVER w) / 2 AS x, (y + avg(y) OVER w) / 2 AS y, (z + avg(z) OVER w) / 2 AS z FROM emb WINDOW w AS (PARTITION BY scene, instance)),
v AS (SELECT * FROM shifted WHERE segment <> -1), {_pairs(0.08, 'v')}, {_ROOTS.format(v='v')}
SELECT scene, dense_rank() OVER (PARTITION BY scene ORDER BY root) - 1 AS cluster, any_value(segment) AS segment, count(*) AS size FROM roots JOIN v USING (scene, point_idx) GROUP BY scene, root HAVING count(*) > 3""")
def point_group(spark, sf):
    """Points moved half way to their instance's centre, clustered by label and radius, numbered in each scene."""
    p = points_emb_s(spark, sf)
    mid = p.groupBy("scene", "instance").agg(*(F.avg(c).alias(f"m{c}") for c in XYZ))
    p = p.join(mid, ["scene", "instance"]).withColumns({c: (F.col(c) + F.col(f"m{c}")) / 2 for c in XYZ})
    found = cluster.number(cluster.proposals(p, 0.08))
    return found.select("scene", "cluster", "segment", "size")


# Lookups

_SNOW = "lineitem l JOIN orders o ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey JOIN nation n ON n_nationkey = c_nationkey JOIN region g ON r_regionkey = n_regionkey"


@query("snowflake_lookup", f"SELECT r_name, n_name, count(*) AS n, {s6('sum(l_quantity)')} AS quantity FROM {_SNOW} GROUP BY ALL")
def snowflake_lookup(spark, sf):
    f = relational.snowflake(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), (table(spark, sf, "orders"), "l_orderkey", "o_orderkey"), (table(spark, sf, "customer"), "o_custkey", "c_custkey"), (table(spark, sf, "nation"), "c_nationkey", "n_nationkey"), (table(spark, sf, "region"), "n_regionkey", "r_regionkey"))
    return f.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("quantity"))


@query("category_remap", f"""WITH {LI}, d AS (SELECT p_partkey % 40 AS raw, arg_min(p_size, p_partkey) AS id FROM part GROUP BY 1), m AS (SELECT scene, point_idx, coalesce(id, 0) AS id FROM li LEFT JOIN d ON raw = part % 50) SELECT scene, point_idx, CASE WHEN id BETWEEN 0 AND 25 THEN id ELSE -1 END AS id FROM m""")
def category_remap(spark, sf):
    dim = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("raw"), F.col("p_size").alias("id"), F.col("p_partkey").alias("pos"))
    p = points_li(spark, sf).withColumn("raw", F.col("part") % 50)
    return relational.remap_categories(p, dim, "raw", range(26)).select("scene", "point_idx", F.col("id").cast("int").alias("id"))


@query("class_positions", f"WITH {LI} SELECT scene, point_idx, CASE segment WHEN 5 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE -1 END AS segment FROM li")
def class_positions(spark, sf):
    return relational.class_positions(points_li(spark, sf), "segment", (5, 3, 1)).select("scene", "point_idx", F.col("segment").cast("int").alias("segment"))


@query("segment_paint", f"""WITH {LI}, g AS (SELECT scene, part % 30 AS segment_id, max(instance % 12) AS group_no FROM li WHERE segment > 2 GROUP BY ALL)
SELECT li.scene, point_idx, coalesce(group_no, -1) AS group_no, coalesce(group_no * 10, -1) AS label FROM li LEFT JOIN g ON g.scene = li.scene AND segment_id = part % 30""")
def segment_paint(spark, sf):
    p = points_li(spark, sf)
    members = p.where("segment > 2").select("scene", (F.col("part") % 30).alias("segment_id"), (F.col("instance") % 12).alias("group_no")).withColumn("label", F.col("group_no") * 10)
    v = p.select("scene", F.col("point_idx").alias("vertex"), (F.col("part") % 30).alias("segment_id"))
    return relational.paint_segments(v, members).select("scene", F.col("vertex").alias("point_idx"), "group_no", "label")


@query("mesh_normals", f"""WITH {LI}, p AS MATERIALIZED (SELECT scene, point_idx, x, y, z, lead(x, 1) OVER w AS bx, lead(y, 1) OVER w AS by_, lead(z, 1) OVER w AS bz, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy, lead(z, 2) OVER w AS cz
    FROM li WINDOW w AS (PARTITION BY scene ORDER BY point_idx)),
k AS MATERIALIZED (SELECT scene, point_idx, (by_ - y) * (cz - z) - (bz - z) * (cy - y) AS nx, (bz - z) * (cx - x) - (bx - x) * (cz - z) AS ny, (bx - x) * (cy - y) - (by_ - y) * (cx - x) AS nz FROM p),
s AS (SELECT scene, point_idx, {', '.join(f'coalesce({n}, 0) + coalesce(lag({n}, 1) OVER w, 0) + coalesce(lag({n}, 2) OVER w, 0) AS {n}' for n in ('nx', 'ny', 'nz'))} FROM k WINDOW w AS (PARTITION BY scene ORDER BY point_idx))
SELECT scene, point_idx, {', '.join(f'{s6(f"coalesce({n} / (sqrt(nx * nx + ny * ny + nz * nz) + 1e-8), 0)")} AS {n}' for n in ('nx', 'ny', 'nz'))} FROM s""")
def mesh_normals(spark, sf):
    v = points_li(spark, sf).select("scene", F.col("point_idx").alias("vertex"), *XYZ)
    w = Window.partitionBy("scene").orderBy("vertex")
    faces = v.select("scene", F.col("vertex").alias("a"), F.lead("vertex", 1).over(w).alias("b"), F.lead("vertex", 2).over(w).alias("c")).where("c is not null")
    n = relational.mesh_normals(v, faces)
    return n.select("scene", F.col("vertex").alias("point_idx"), *(r6(c).alias(c) for c in ("nx", "ny", "nz")))


@query("linked_sweeps", f"""WITH RECURSIVE {FR}, s AS (SELECT event_id AS id, lag(event_id) OVER (PARTITION BY sequence ORDER BY frame_no) AS prev FROM fr),
w AS (SELECT id, 1 AS hop, prev AS prev_id FROM s WHERE prev IS NOT NULL UNION ALL SELECT w.id, hop + 1, s.prev FROM w JOIN s ON s.id = w.prev_id WHERE s.prev IS NOT NULL AND hop < 5) SELECT id, hop, prev_id FROM w""")
def linked_sweeps(spark, sf):
    f = frames_ev(spark, sf)
    s = f.select(F.col("event_id").alias("id"), F.lag("event_id").over(Window.partitionBy("sequence").orderBy("frame_no")).alias("prev"))
    return relational.sweeps_by_prev(s, limit=5)


@query("subm_conv_offsets", f"""WITH {EMB_S}, c AS (SELECT DISTINCT scene, CAST(floor(x / 0.1::DOUBLE) AS BIGINT) AS gx, CAST(floor(y / 0.1::DOUBLE) AS BIGINT) AS gy, CAST(floor(z / 0.1::DOUBLE) AS BIGINT) AS gz FROM emb),
v AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY gx, gy, gz) - 1 AS id FROM c)
SELECT a.scene, a.id AS out, CAST(((b.gx - a.gx + 1) * 3 + b.gy - a.gy + 1) * 3 + b.gz - a.gz + 1 AS INT) AS "offset", b.id AS "in" FROM v a JOIN v b ON a.scene = b.scene AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND abs(a.gz - b.gz) <= 1""")
def subm_conv_offsets(spark, sf):
    v = voxel.voxel_ids(voxel.cells(points_emb_s(spark, sf), 0.1))
    return relational.convolution_pairs(v)


@query("param_groups", "SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 0.1 WHEN p_name LIKE '%ring%' THEN 0.2 ELSE 1.0 END::DOUBLE AS value FROM part")
def param_groups(spark, sf):
    return relational.first_keyword(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", [("red", 0.1), ("ring", 0.2)], 1.0).select("p_partkey", "value")


# Series


@query("frame_fusion", f"WITH {FR} SELECT i.sequence, i.frame_no, f.frame_no AS from_frame, CAST(k AS INT) AS time, f.value FROM fr i, (VALUES (0), (-1), (-2)) s(k) JOIN fr f ON f.sequence = i.sequence AND f.frame_no = i.frame_no + k")
def frame_fusion(spark, sf):
    return series.fuse_frames(frames_ev(spark, sf)).select("sequence", "frame_no", "from_frame", "time", "value")


@query("sweep_chain", f"WITH {FR} SELECT sequence, frame_no, {', '.join(f'coalesce(lag(event_id, {k}) OVER w, first_value(event_id) OVER w) AS s{k}' for k in (1, 2, 3, 4))} FROM fr WINDOW w AS (PARTITION BY sequence ORDER BY frame_no)")
def sweep_chain(spark, sf):
    c = series.sweep_chain(frames_ev(spark, sf), 5)
    return c.select("sequence", "frame_no", *(F.element_at("sweeps", k).alias(f"s{k}") for k in (1, 2, 3, 4)))


@query("sequence_bounds", f"WITH {FR} SELECT sequence, min(frame_no) AS first_frame, count(*) AS n FROM fr GROUP BY sequence")
def sequence_bounds(spark, sf):
    return series.sequence_bounds(frames_ev(spark, sf))


def _metric(spark, sf):
    """Metric histories: one for each user's events of a type, so that a history does not grow with the number of users."""
    return table(spark, sf, "events").select(F.concat_ws("/", "event_type", "user_id").alias("name"), F.col("event_id").alias("iteration"), "value")


_ME = "me AS (SELECT concat_ws('/', event_type, user_id) AS name, event_id AS iteration, value FROM events)"


@query("moving_median", f"WITH {_ME} SELECT name, iteration, {s6('median(value) OVER w')} AS median, {s6('avg(value) OVER w')} AS mean FROM me WINDOW w AS (PARTITION BY name ORDER BY iteration ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def moving_median(spark, sf):
    return series.moving_median(_metric(spark, sf), 5).select("name", "iteration", r6("median").alias("median"), r6("mean").alias("mean"))


@query("running_mean", f"WITH {_ME} SELECT name, iteration, {s6('avg(value) OVER (PARTITION BY name ORDER BY iteration)')} AS avg, {s6('(100000 - iteration) * avg(value) OVER (PARTITION BY name ORDER BY iteration)')} AS eta FROM me")
def running_mean(spark, sf):
    return series.remaining_time(_metric(spark, sf), 100_000).select("name", "iteration", r6("avg").alias("avg"), r6("eta").alias("eta"))


@query("latest_smoothed", f"WITH {_ME}, k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY iteration DESC) AS r FROM me) SELECT name, {s6('median(value)')} AS latest, max(iteration) AS iteration FROM k WHERE r <= 5 GROUP BY name")
def latest_smoothed(spark, sf):
    return series.latest(_metric(spark, sf), 5).select("name", r6("latest").alias("latest"), "iteration")


@query("latest_value", f"WITH {_ME} SELECT name, arg_max(value, iteration) AS latest, max(iteration) AS iteration FROM me GROUP BY name")
def latest_value(spark, sf):
    return series.latest(_metric(spark, sf))


@query("best_so_far", f"WITH {_ME} SELECT name, iteration, max(value) OVER (PARTITION BY name ORDER BY iteration) AS best, coalesce(value > max(value) OVER (PARTITION BY name ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM me")
def best_so_far(spark, sf):
    return series.best_so_far(_metric(spark, sf)).select("name", "iteration", "best", "is_best")


_EVENTS = ["click", "error", "purchase", "signup", "view"]


@query("metrics_wide", "SELECT user_id AS iteration, " + ", ".join(f"arg_max(value, event_id) FILTER (WHERE event_type = '{e}') AS \"{e}\"" for e in _EVENTS) + " FROM events GROUP BY user_id")
def metrics_wide(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("iteration")).pivot("event_type", _EVENTS).agg(F.max_by("value", "event_id"))


@query("interleave", """WITH s AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS j, 0 AS source FROM supplier), n AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_nationkey) - 1 AS j, (SELECT count(*) FROM nation) AS n FROM nation),
t AS (SELECT CAST(ceil((SELECT count(*) FROM supplier) / 3) AS BIGINT) AS turns)
SELECT id, source, CAST(j // 3 * 5 + j % 3 AS BIGINT) AS slot FROM s UNION ALL SELECT n.id, 1, CAST(p // 2 * 5 + 3 + p % 2 AS BIGINT) FROM t, generate_series(0, (SELECT turns * 2 - 1 FROM t)) g(p) JOIN n ON n.j = p % n.n""")
def interleave(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return series.interleave([a, b], [3, 2], "id").select("id", "source", "slot")


_S = "generate_series(0, 999) g(step)"


def _sched(name, sql, column):
    @query(name, f"SELECT step, {s6(sql)} AS lr FROM {_S}")
    def run(spark, sf):
        return series.steps(spark, 1000).select("step", r6(column()).alias("lr"))

    return run


_MS = "0.1::DOUBLE * pow(0.1::DOUBLE, (step >= 600)::INT + (step >= 800)::INT)"
_sched("multistep_lr", _MS, lambda: series.multi_step((0.6, 0.8), 1000, 0.1))
_sched("multistep_warmup_lr", f"{_MS} * CASE WHEN step <= 50 THEN 1.0 - (1.0 - step / 50.0) * (1.0 - 1e-6) ELSE 1 END", lambda: series.multi_step_warmup((0.6, 0.8), 1000, 0.1))
_sched("poly_lr", "0.1::DOUBLE * pow(1.0 - step / 1001.0, 0.9::DOUBLE)", lambda: series.poly(1000, 0.1))
_sched("exp_lr", "0.1::DOUBLE * pow(0.9::DOUBLE, step / 1000.0)", lambda: series.exponential(1000, 0.1))
_sched("cosine_lr", "0.1::DOUBLE * (1.0 + cos(pi() * step / 1000)) / 2", lambda: series.cosine(1000, 0.1))
_sched("onecycle_lr", "CASE WHEN step <= 299 THEN 0.1::DOUBLE + (0.004::DOUBLE - 0.1) / 2 * (1 + cos(pi() * step / 299)) ELSE 0.0000004::DOUBLE + (0.1 - 0.0000004) / 2 * (1 + cos(pi() * (step - 299) / 700)) END", lambda: series.one_cycle(1000, 0.1))
_sched("cosine_warmup_lr", "CASE WHEN step < 20 THEN 0 WHEN step < 120 THEN 0.1::DOUBLE * (step - 20) / 99 WHEN step < 900 THEN 0.001::DOUBLE + 0.5 * (0.1 - 0.001) * (1 + cos(pi() * (step - 120) / 780)) ELSE 0.001 END", lambda: series.cosine_warmup(900, 0.1, 0.001, 100, 0.0, 20))


# Losses


def _logits(spark, sf):
    """Four logits per embedding; the target is its segment."""
    p = points_emb_s(spark, sf).select("scene", "point_idx", F.col("segment").alias("target"), F.posexplode(F.slice("feat", 1, 3)).alias("class", "v"))
    return p.select("scene", "point_idx", "target", F.col("class").cast("long").alias("class"), (F.col("v") * 4).alias("logit"))


_LG = f"{EMB_S}, lg AS (SELECT scene, point_idx, segment AS target, CAST(c - 1 AS BIGINT) AS class, feat[c] * 4 AS logit FROM emb, generate_series(1, 3) s(c) WHERE segment <> -1), sm AS (SELECT *, logit - ln(sum(exp(logit)) OVER (PARTITION BY scene, point_idx)) AS logp FROM lg)"
_K = ["scene", "point_idx"]


@query("ce_loss", f"WITH {_LG} SELECT {s6('avg(-logp)')} AS loss FROM sm WHERE class = target")
def ce_loss(spark, sf):
    return losses.cross_entropy(_logits(spark, sf), _K).select(r6("loss").alias("loss"))


@query("smooth_ce_loss", f"WITH {_LG} SELECT {s6('sum(-logp * CASE WHEN class = target THEN 0.9 ELSE 0.05 END::DOUBLE) / count(*) FILTER (WHERE class = target)')} AS loss FROM sm")
def smooth_ce_loss(spark, sf):
    return losses.smooth_ce(_logits(spark, sf), _K).select(r6("loss").alias("loss"))


_BCE = "(greatest(logit, 0) - logit * t + ln(1 + exp(-abs(logit))))"


@query("focal_loss", f"WITH {_LG}, f AS (SELECT *, (class = target)::INT AS t, 1 / (1 + exp(-logit)) AS p FROM lg) SELECT {s6(f'sum(0.5 * pow((1 - p) * t + p * (1 - t), 2) * {_BCE}) / count(*) * 3')} AS loss FROM f")
def focal_loss(spark, sf):
    return losses.focal(_logits(spark, sf), _K, 3).select(r6("loss").alias("loss"))


@query("binary_focal_loss", f"WITH {_LG}, f AS (SELECT *, (class = target)::INT AS t FROM lg), e AS (SELECT {_BCE} AS b FROM f) SELECT {s6('avg(0.5 * pow(1 - exp(-b), 2) * b)')} AS loss FROM e")
def binary_focal_loss(spark, sf):
    d = _logits(spark, sf).where("target <> -1").select("logit", (F.col("class") == F.col("target")).cast("int").alias("target"))
    return losses.binary_focal(d).select(r6("loss").alias("loss"))


@query("dice_loss", f"WITH {_LG}, d AS (SELECT class, 1 - (2 * sum(CASE WHEN class = target THEN exp(logp) ELSE 0 END) + 1) / (sum(exp(logp) * exp(logp) + (class = target)::INT) + 1) AS l FROM sm GROUP BY class) SELECT {s6('avg(l)')} AS loss FROM d")
def dice_loss(spark, sf):
    return losses.dice(_logits(spark, sf), _K).select(r6("loss").alias("loss"))


_LOVASZ = """j AS (SELECT *, 1 - (g - c) / (g + k - c) AS jac FROM (SELECT *, sum(fg) OVER (PARTITION BY class) AS g, sum(fg) OVER o AS c, row_number() OVER o AS k FROM e WINDOW o AS (PARTITION BY class ORDER BY error DESC, scene, point_idx))),
t AS (SELECT *, jac - coalesce(lag(jac) OVER (PARTITION BY class ORDER BY k), 0) AS step FROM j)"""


@query("lovasz_loss", f"WITH {_LG}, e AS (SELECT class, scene, point_idx, (class = target)::INT::DOUBLE AS fg, abs((class = target)::INT - exp(logp)) AS error FROM sm), {_LOVASZ}, l AS (SELECT class, sum(error * step) AS l FROM t GROUP BY class) SELECT {s6('avg(l)')} AS loss FROM l")
def lovasz_loss(spark, sf):
    return losses.lovasz_softmax(_logits(spark, sf), _K).select(r6("loss").alias("loss"))


@query("lovasz_hinge_loss", f"WITH {_LG}, e AS (SELECT class, scene, point_idx, (class = target)::INT::DOUBLE AS fg, 1 - logit * (2 * (class = target)::INT - 1) AS error FROM lg), {_LOVASZ} SELECT class, {s6('sum(greatest(error, 0) * step)')} AS loss FROM t GROUP BY class")
def lovasz_hinge_loss(spark, sf):
    d = _logits(spark, sf).where("target <> -1").select("class", F.struct(*_K).alias("id"), "logit", (F.col("class") == F.col("target")).cast("int").alias("target"))
    return losses.lovasz_hinge(d, ["class"]).select("class", r6("loss").alias("loss"))


@query("offset_loss", f"""WITH {EMB_S}, c AS (SELECT *, feat[1] AS ox, feat[2] AS oy, feat[3] AS oz, avg(x) OVER w - x AS gx, avg(y) OVER w - y AS gy, avg(z) OVER w - z AS gz FROM emb WINDOW w AS (PARTITION BY scene, instance))
SELECT {s6('sum(abs(ox - gx) + abs(oy - gy) + abs(oz - gz)) / (count(*) + 1e-8)')} AS l1, {s6('-sum((ox * gx + oy * gy + oz * gz) / ((sqrt(ox * ox + oy * oy + oz * oz) + 1e-8) * (sqrt(gx * gx + gy * gy + gz * gz) + 1e-8))) / (count(*) + 1e-8)')} AS cosine FROM c""")
def offset_loss(spark, sf):
    p = points_emb_s(spark, sf)
    mid = p.groupBy("scene", "instance").agg(*(F.avg(c).alias(f"c{c}") for c in XYZ))
    p = p.join(mid, ["scene", "instance"]).withColumns({f"o{c}": F.element_at("feat", i + 1) for i, c in enumerate(XYZ)})
    return losses.offset_loss(p).select(r6("l1").alias("l1"), r6("cosine").alias("cosine"))


def _rope_sql(axis: int, g: str) -> str:
    a, b = f"feat[{axis * 2 + 1}]", f"feat[{axis * 2 + 2}]"
    return f"{s6(f'{a} * cos({g}) - {b} * sin({g})')} AS f{axis * 2}, {s6(f'{b} * cos({g}) + {a} * sin({g})')} AS f{axis * 2 + 1}"


@query("rope", f"WITH {EMB_S}, c AS (SELECT scene, point_idx, feat, floor(x / 0.05::DOUBLE) AS gx, floor(y / 0.05::DOUBLE) AS gy, floor(z / 0.05::DOUBLE) AS gz FROM emb) SELECT scene, point_idx, {', '.join(_rope_sql(i, g) for i, g in enumerate(('gx', 'gy', 'gz')))} FROM c")
def rope(spark, sf):
    p = points_emb_s(spark, sf)
    g = [F.floor(F.col(c) / 0.05) for c in XYZ]
    out = p.select("scene", "point_idx", losses.rope(F.col("feat"), *g, dim=6).alias("f"))
    return out.select("scene", "point_idx", *(r6(F.element_at("f", i + 1)).alias(f"f{i}") for i in range(6)))


@query("patch_attention", f"""WITH {EMB_S}, s AS (SELECT scene, feat, (row_number() OVER (PARTITION BY scene ORDER BY point_idx) - 1) AS k FROM emb), p AS (SELECT scene, k // 16 AS patch, k % 16 AS slot, feat FROM s),
w AS (SELECT a.scene, a.patch, a.slot, exp({_DOT}) AS e, b.feat AS v FROM p a JOIN p b ON a.scene = b.scene AND a.patch = b.patch)
SELECT scene, patch, slot, {s6('sum(e * v[1]) / sum(e)')} AS v1, {s6('sum(e * v[8]) / sum(e)')} AS v8 FROM w GROUP BY ALL""")
def patch_attention(spark, sf):
    k = F.row_number().over(Window.partitionBy("scene").orderBy("point_idx")) - 1
    p = points_emb_s(spark, sf).withColumn("k", k.cast("long")).select("scene", F.floor(F.col("k") / 16).alias("patch"), (F.col("k") % 16).alias("slot"), F.col("feat").alias("q"), F.col("feat").alias("k"), F.col("feat").alias("v"))
    a = losses.patch_attention(p)
    return a.select("scene", "patch", "slot", r6(F.element_at("out", 1)).alias("v1"), r6(F.element_at("out", 8)).alias("v8"))


_W1 = [[0.1 * (i - j) for j in range(8)] for i in range(3)]
_H = [" + ".join(f"feat[{j + 1}] * ({w}::DOUBLE)" for j, w in enumerate(row)) for row in _W1]


@query("mlp_head", f"WITH {EMB_S}, h AS (SELECT scene, point_idx, {', '.join(f'{e} + {i} AS h{i}' for i, e in enumerate(_H))} FROM emb), g AS (SELECT scene, point_idx, {', '.join(f'0.5 * h{i} * (1 + tanh(0.7978845608028654::DOUBLE * (h{i} + 0.044715::DOUBLE * h{i} * h{i} * h{i}))) AS h{i}' for i in range(3))} FROM h) SELECT scene, point_idx, {s6('h0 - h1 + 0.5 * h2 + 0.25')} AS o0 FROM g")
def mlp_head(spark, sf):
    p = points_emb_s(spark, sf).select("scene", "point_idx", losses.mlp(F.col("feat"), _W1, [0.0, 1.0, 2.0], [[1.0, -1.0, 0.5]], [0.25]).alias("o"))
    return p.select("scene", "point_idx", r6(F.element_at("o", 1)).alias("o0"))


@query("sparse_convolution", f"""WITH {EMB_S}, c AS (SELECT scene, CAST(floor(x / 0.1::DOUBLE) AS BIGINT) AS gx, CAST(floor(y / 0.1::DOUBLE) AS BIGINT) AS gy, CAST(floor(z / 0.1::DOUBLE) AS BIGINT) AS gz, max(feat[1]) AS f1, max(feat[2]) AS f2 FROM emb GROUP BY 1, 2, 3, 4),
v AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY gx, gy, gz) - 1 AS id FROM c),
p AS (SELECT a.scene, a.id AS out, ((b.gx - a.gx + 1) * 3 + b.gy - a.gy + 1) * 3 + b.gz - a.gz + 1 AS o, b.f1, b.f2 FROM v a JOIN v b ON a.scene = b.scene AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND abs(a.gz - b.gz) <= 1)
SELECT scene, out, CAST(c AS INT) AS channel, {s6('sum(f1 * (o * 0.01 + c) + f2 * (o * 0.01 + c - 1))')} AS value FROM p, generate_series(0, 1) s(c) GROUP BY ALL""")
def sparse_convolution(spark, sf):
    c = voxel.cells(points_emb_s(spark, sf), 0.1)
    ids = voxel.voxel_ids(c)
    f = c.groupBy("scene", "gx", "gy", "gz").agg(F.max(F.element_at("feat", 1)).alias("f1"), F.max(F.element_at("feat", 2)).alias("f2")).join(ids, ["scene", "gx", "gy", "gz"]).select("scene", "voxel_id", F.array("f1", "f2").alias("feat"))
    w = spark.range(27).select(F.col("id").cast("int").alias("offset"), F.explode(F.array(F.lit(0), F.lit(1))).alias("channel")).withColumn("in_channel", F.explode(F.array(F.lit(0), F.lit(1))))
    w = w.withColumn("weight", F.col("offset") * 0.01 + F.col("channel") - F.col("in_channel"))
    return losses.sparse_convolution(relational.convolution_pairs(ids), f, w).select("scene", "out", "channel", r6("value").alias("value"))


@query("hilbert_round_trip", f"WITH {LI} SELECT scene, point_idx, true AS same FROM li")
def hilbert_round_trip(spark, sf):
    c = voxel.cells(points_li(spark, sf), 0.5)
    back = curve.decode(curve.encode(c.select("scene", "point_idx", *(F.col(g).alias(f"o{g}") for g in ("gx", "gy", "gz")), "gx", "gy", "gz"), "hilbert"), "hilbert")
    return back.select("scene", "point_idx", ((F.col("gx") == F.col("ogx")) & (F.col("gy") == F.col("ogy")) & (F.col("gz") == F.col("ogz"))).alias("same"))


@query("asof_join", "WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts, value AS click FROM events WHERE event_type = 'click') SELECT v.user_id, v.event_id, c.click FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.ts >= c.ts")
def asof_join(spark, sf):
    e = table(spark, sf, "events")
    v = e.where("event_type = 'view'").select("user_id", "ts", "event_id")
    c = e.where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("click"))
    return series.asof_join(v, c, "user_id", "ts", ["click"]).select("user_id", "event_id", "click")
