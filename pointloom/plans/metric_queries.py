"""Queries over predictions and instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import metrics as m
from . import query
from .views import EMB_S, PREDS, points_emb_s, preds_li, r6 as s6

K = 6


@query("confusion", f"WITH {PREDS} SELECT target, pred, count(*) AS n FROM pr WHERE target BETWEEN 0 AND 5 GROUP BY target, pred")
def confusion(spark, sf):
    return m.confusion(preds_li(spark, sf), K)


@query("confusion_normalized", f"WITH {PREDS}, c AS (SELECT target, pred, count(*) AS n FROM pr WHERE target BETWEEN 0 AND 5 GROUP BY target, pred) SELECT target, pred, n, {s6('n / sum(n) OVER (PARTITION BY target)')} AS by_target, {s6('n / sum(n) OVER (PARTITION BY pred)')} AS by_pred FROM c")
def confusion_normalized(spark, sf):
    return m.normalized(m.confusion(preds_li(spark, sf), K)).select("target", "pred", "n", r6("by_target").alias("by_target"), r6("by_pred").alias("by_pred"))


_AREA = """v AS (SELECT * FROM pr WHERE target BETWEEN 0 AND 5), k AS (SELECT CAST(k AS BIGINT) AS class FROM generate_series(0, 5) s(k)),
a AS (SELECT class, count(*) FILTER (WHERE target = class AND pred = class) AS i, count(*) FILTER (WHERE pred = class) AS p, count(*) FILTER (WHERE target = class) AS t FROM v, k GROUP BY class)"""


@query("iou", f"WITH {PREDS}, {_AREA} SELECT class, CAST(i AS BIGINT) AS intersection, CAST(p + t - i AS BIGINT) AS \"union\", CAST(t AS BIGINT) AS target, {s6('i / (p + t - i + 1e-8) + 1e-8')} AS iou FROM a WHERE p + t > 0")
def iou(spark, sf):
    return m.iou(m.areas(preds_li(spark, sf), K)).select("class", "intersection", "union", "target", r6("iou").alias("iou"))


@query("miou_present", f"WITH {PREDS}, {_AREA} SELECT {s6('avg(i / (p + t - i + 1e-8) + 1e-8) FILTER (WHERE p + t > 0)')} AS miou, {s6('avg(i / t) FILTER (WHERE t > 0)')} AS macc, {s6('sum(i) / sum(t)')} AS oa FROM a")
def miou_present(spark, sf):
    return m.all_metrics(preds_li(spark, sf), K).select(*(r6(c).alias(c) for c in ("miou", "macc", "oa")))


@query("miou_all", f"WITH {PREDS}, {_AREA.replace('(0, 5) s(k)', '(0, 7) s(k)')} SELECT {s6('avg(i / (p + t - i + 1e-10))')} AS miou, {s6('avg(i / (t + 1e-10))')} AS macc, {s6('sum(i) / (sum(t) + 1e-10)')} AS allacc FROM a")
def miou_all(spark, sf):
    return m.dense_metrics(preds_li(spark, sf), 8).select(*(r6(c).alias(c) for c in ("miou", "macc", "allacc")))


@query("scene_iou", f"WITH {PREDS}, v AS (SELECT * FROM pr WHERE target BETWEEN 0 AND 5), k AS (SELECT k AS class FROM generate_series(0, 5) s(k)), a AS (SELECT scene, class, count(*) FILTER (WHERE target = class AND pred = class) AS i, count(*) FILTER (WHERE pred = class OR target = class) AS u FROM v, k GROUP BY ALL) SELECT scene, {s6('avg(i / (u + 1e-10))')} AS iou FROM a WHERE u > 0 GROUP BY scene")
def scene_iou(spark, sf):
    return m.scene_iou(preds_li(spark, sf), K).select("scene", r6("iou").alias("iou"))


def _hist(spark, sf):
    return preds_li(spark, sf).where("target >= 0").groupBy(F.col("part").alias("item"), F.col("target").alias("class")).agg(F.count("*").alias("cnt"))


_HIST = "h AS (SELECT part AS item, target AS class, count(*) AS cnt FROM pr WHERE target >= 0 GROUP BY ALL), mj AS (SELECT item, arg_max(class, cnt * 1000 - class) AS pred FROM h GROUP BY item)"


@query("hist_confusion", f"WITH {PREDS}, {_HIST} SELECT class AS target, pred, CAST(sum(cnt) AS BIGINT) AS n FROM h JOIN mj USING (item) GROUP BY class, pred")
def hist_confusion(spark, sf):
    h = _hist(spark, sf)
    return m.confusion_of_histograms(h.join(m.majority(h), "item"))


def _scores(spark, sf):
    """Softmax-like scores of two fragments: each embedding's first features by class."""
    p = points_emb_s(spark, sf).select("scene", "point_idx", F.posexplode("feat").alias("i", "v"))
    return p.select("scene", "point_idx", (F.col("i") % 4).cast("long").alias("class"), F.floor(F.col("i") / 4).alias("fragment"), F.exp("v").alias("score"))


_SC = f"{EMB_S}, sc AS (SELECT scene, point_idx, CAST((i - 1) % 4 AS BIGINT) AS class, exp(feat[i]) AS score FROM emb, generate_series(1, 8) s(i)), vt AS (SELECT scene, point_idx, class, sum(score) AS s FROM sc GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY scene, point_idx ORDER BY s DESC, class) AS r FROM vt)"


@query("vote_argmax", f"WITH {_SC} SELECT scene, point_idx, class AS pred FROM rk WHERE r = 1")
def vote_argmax(spark, sf):
    return m.vote(_scores(spark, sf))


@query("ensemble_vote", f"WITH {_SC} SELECT scene, point_idx, class AS pred FROM rk WHERE r = 1")
def ensemble_vote(spark, sf):
    return m.vote(_scores(spark, sf), how="mean")


@query("top3", f"WITH {_SC} SELECT scene, point_idx, string_agg(CAST(class AS VARCHAR), ',' ORDER BY r) AS classes FROM rk WHERE r <= 3 GROUP BY scene, point_idx")
def top3(spark, sf):
    s = _scores(spark, sf).groupBy("scene", "point_idx", "class").agg(F.sum("score").alias("score"))
    return m.top_classes(s, 3)


@query("part_iou", f"""WITH {PREDS}, s AS (SELECT scene AS shape, scene % 3 AS category, (scene % 3) * 2 + target % 2 AS t, (scene % 3) * 2 + pred % 2 AS p FROM pr WHERE target >= 0), g AS (SELECT DISTINCT shape, category, category * 2 + k AS part FROM s, (VALUES (0), (1)) v(k)),
a AS (SELECT g.category, g.shape, part, count(*) FILTER (WHERE t = part AND p = part) AS i, count(*) FILTER (WHERE t = part OR p = part) AS u FROM g JOIN s ON s.shape = g.shape GROUP BY ALL) SELECT category, shape, {s6('avg(CASE WHEN u = 0 THEN 1 ELSE i / u END)')} AS iou FROM a GROUP BY ALL""")
def part_iou(spark, sf):
    c = F.col("scene") % 3
    d = preds_li(spark, sf).where("target >= 0").select(F.col("scene").alias("shape"), c.alias("category"), (c * 2 + F.col("target") % 2).alias("target"), (c * 2 + F.col("pred") % 2).alias("pred"))
    parts = spark.range(6).select(F.floor(F.col("id") / 2).alias("category"), F.col("id").alias("part"))
    return m.part_iou(d, parts).select("category", "shape", r6("iou").alias("iou"))


@query("instance_parse", f"""WITH {EMB_S}, v AS (SELECT * FROM emb WHERE segment <> -1 AND instance >= 0), g AS (SELECT scene, instance, arg_min(segment, point_idx) AS segment, count(*) AS n, {', '.join(f'min({c}) AS lo{c}, max({c}) AS hi{c}, avg({c}) AS m{c}' for c in 'xyz')} FROM v GROUP BY ALL)
SELECT scene, instance, row_number() OVER (PARTITION BY scene ORDER BY instance) - 1 AS id, segment AS class, n, {', '.join(f'{s6(f"(lo{c} + hi{c}) / 2")} AS box_{c}, {s6(f"hi{c} - lo{c}")} AS size_{c}, {s6(f"m{c}")} AS c{c}' for c in 'xyz')} FROM g""")
def instance_parse(spark, sf):
    p = m.parse_instances(points_emb_s(spark, sf))
    return p.select("scene", "instance", "id", "class", "n", *(r6(f"{k}{c}").alias(f"{k}{c}") for c in "xyz" for k in ("box_", "size_", "c")))


def _gt_pred(spark, sf):
    """Ground truth: a part's points of a scene, class by part; proposals: the same runs cut at another place."""
    p = preds_li(spark, sf)
    gt = p.select("scene", "point_idx", F.floor(F.col("point_idx") / 40).alias("instance"), F.when(F.floor(F.col("point_idx") / 40) % 5 == 0, F.lit(-1)).otherwise(F.floor(F.col("point_idx") / 40) % 3).cast("long").alias("class"))
    pred = p.select("scene", "point_idx", F.floor((F.col("point_idx") + F.col("scene") % 30) / 40).alias("proposal"), (F.floor((F.col("point_idx") + F.col("scene") % 30) / 40) % 3).alias("class"))
    return gt, pred


_GP = PREDS + """, gp AS (SELECT scene, point_idx, point_idx // 40 AS instance, CASE WHEN point_idx // 40 % 5 = 0 THEN -1 ELSE point_idx // 40 % 3 END AS class, (point_idx + scene % 30) // 40 AS proposal, (point_idx + scene % 30) // 40 % 3 AS pclass FROM pr),
g AS (SELECT scene, instance, any_value(class) AS class, count(*) AS gt_n FROM gp WHERE class >= 0 GROUP BY ALL),
p AS (SELECT scene, proposal, any_value(pclass) AS class, count(*) AS pred_n, count(*) FILTER (WHERE class < 0) AS void FROM gp GROUP BY ALL HAVING count(*) >= 10),
mt AS (SELECT scene, instance, proposal, g.class, n AS intersection, gt_n, pred_n, void, n / (gt_n + pred_n - n) AS iou FROM (SELECT scene, instance, proposal, count(*) AS n FROM gp WHERE class >= 0 GROUP BY ALL) x JOIN g USING (scene, instance) JOIN p USING (scene, proposal) WHERE g.class = p.class)"""


@query("instance_match", f"WITH {_GP} SELECT scene, instance, proposal, class, intersection, gt_n, pred_n, void, {s6('iou')} AS iou FROM mt")
def instance_match(spark, sf):
    gt, pred = _gt_pred(spark, sf)
    x = m.match_instances(gt, pred, 10)
    return x.select("scene", "instance", "proposal", "class", "intersection", "gt_n", "pred_n", "void", r6("iou").alias("iou"))


def _ap(spark, sf):
    gt, pred = _gt_pred(spark, sf)
    props = pred.join(gt.select("scene", "point_idx", F.col("class").alias("_c")), ["scene", "point_idx"]).groupBy("scene", "proposal").agg(F.min("class").alias("class"), F.count("*").alias("n"), F.sum((F.col("_c") < 0).cast("long")).alias("void")).where("n >= 10")
    props = props.withColumn("score", (F.col("scene") * 31 + F.col("proposal") * 17) % 101 / 101)
    truth = gt.where("class >= 0").groupBy("scene", "instance").agg(F.min("class").alias("class"), F.count("*").alias("n"))
    return m.average_precision(m.match_instances(gt, pred, 10), truth, props)


_AP = _GP + """, th AS (SELECT * FROM (VALUES (0.5), (0.55), (0.6), (0.65), (0.7), (0.75), (0.8), (0.85), (0.9), (0.25)) t(th)), sc AS (SELECT *, (scene * 31 + proposal * 17) % 101 / 101 AS score FROM p),
hit AS (SELECT th, class, scene, proposal, max(first) AS tp, any_value(score) AS score FROM (SELECT th, mt.class, scene, proposal, score, (row_number() OVER (PARTITION BY th, mt.class, scene, instance ORDER BY score DESC, proposal) = 1)::INT AS first FROM mt JOIN sc USING (scene, proposal), th WHERE iou > th) GROUP BY ALL),
ev AS (SELECT th, class, score, tp FROM hit UNION ALL SELECT th, class, score, 0 FROM sc, th WHERE void / pred_n <= th AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.th = th.th AND hit.scene = sc.scene AND hit.proposal = sc.proposal)),
e2 AS (SELECT th, class, score, sum(tp) AS tp, count(*) AS k FROM ev GROUP BY ALL), ng AS (SELECT class, count(*) AS n_gt FROM g GROUP BY class),
pr2 AS (SELECT th, class, score, n_gt, sum(tp) OVER w / sum(k) OVER w AS pc, sum(tp) OVER w / n_gt AS rc FROM e2 JOIN ng USING (class) WINDOW w AS (PARTITION BY th, class ORDER BY score DESC)),
st AS (SELECT *, coalesce(lag(rc) OVER w, 0) AS b, coalesce(lead(rc) OVER w, rc) AS a, lag(rc) OVER w IS NULL AS f FROM pr2 WINDOW w AS (PARTITION BY th, class ORDER BY score DESC)),
ap AS (SELECT class, th AS iou, sum(pc * (a - b) / 2) + max(CASE WHEN f THEN rc / 2 ELSE 0 END) AS ap, any_value(n_gt) AS n_gt FROM st GROUP BY ALL)"""


@query("ap_table", f"WITH {_AP} SELECT class, CAST(iou AS DOUBLE) AS iou, {s6('ap')} AS ap, n_gt FROM ap")
def ap_table(spark, sf):
    return _ap(spark, sf).select("class", "iou", r6("ap").alias("ap"), "n_gt")


@query("ap_summary", f"WITH {_AP} SELECT {s6('avg(ap) FILTER (WHERE iou >= 0.5)')} AS ap, {s6('avg(ap) FILTER (WHERE iou = 0.5)')} AS ap50, {s6('avg(ap) FILTER (WHERE iou = 0.25)')} AS ap25 FROM ap")
def ap_summary(spark, sf):
    return m.ap_summary(_ap(spark, sf)).select(*(r6(c).alias(c) for c in ("ap", "ap50", "ap25")))


@query("average_meter", f"SELECT event_type, {s6('sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1)')} AS avg, CAST(sum(event_id % 7 + 1) AS BIGINT) AS count FROM events GROUP BY event_type")
def average_meter(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("n", F.col("event_id") % 7 + 1)
    return m.weighted_mean(e, "event_type", "value", "n").select("event_type", r6("avg").alias("avg"), "count")


@query("gradient_norm", f"SELECT event_type, {s6('sqrt(sum(value * value))')} AS norm FROM events GROUP BY event_type")
def gradient_norm(spark, sf):
    return m.gradient_norm(spark.read.parquet(f"{sf}/events.parquet"), "value", ("event_type",)).select("event_type", r6("norm").alias("norm"))


@query("iou_rollup", f"WITH {PREDS}, {_AREA} SELECT class, CAST(sum(i) AS BIGINT) AS intersection, CAST(sum(t) AS BIGINT) AS target, {s6('sum(i) / (sum(p + t - i) + 1e-10)')} AS iou FROM a GROUP BY ROLLUP (class)")
def iou_rollup(spark, sf):
    return m.rolled_up(preds_li(spark, sf), K).select("class", "intersection", "target", r6("iou").alias("iou"))


@query("best_record", "SELECT event_type, max(value) AS value, arg_min(event_id, (-value, event_id)) AS event_id FROM events GROUP BY event_type")
def best_record(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value", "event_id")
    return m.best_record(e, "value", ("event_type",))
