"""Segmentation and instance metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .losses import log_softmax

IOUS = tuple(round(0.5 + 0.05 * i, 2) for i in range(9)) + (0.25,)


def valid(df: DataFrame, classes: int) -> DataFrame:
    return df.where((F.col("target") >= 0) & (F.col("target") < classes))


def confusion(df: DataFrame, classes: int) -> DataFrame:
    """(target, pred, n) of labelled points; void targets are left out."""
    return valid(df, classes).groupBy("target", "pred").agg(F.count("*").alias("n"))


def confusion_of_histograms(hist: DataFrame) -> DataFrame:
    """(target, pred, n) from rows (pred, class, cnt): each item's label counts against its prediction."""
    return hist.groupBy(F.col("class").alias("target"), "pred").agg(F.sum("cnt").alias("n"))


def majority(hist: DataFrame, item: str = "item") -> DataFrame:
    """Each item's most frequent class, the least of equals."""
    return hist.groupBy(item).agg(F.max_by("class", F.struct("cnt", -F.col("class"))).alias("pred"))


def normalized(cm: DataFrame) -> DataFrame:
    """With the shares of each count in its row and column, 0 where those are empty."""
    row, column = Window.partitionBy("target"), Window.partitionBy("pred")
    share = lambda w: F.coalesce(F.try_divide("n", F.sum("n").over(w)), F.lit(0.0))
    return cm.withColumns({"by_target": share(row), "by_pred": share(column)})


def areas(df: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Per class its intersection, prediction, target and union counts over points with a valid target; classes without any are absent."""
    v = valid(df, classes)
    pairs = v.groupBy(*by, "target", "pred").agg(F.count("*").alias("n"))
    as_target = pairs.select(*by, F.col("target").alias("class"), F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0).alias("i"), F.lit(0).alias("p"), F.col("n").alias("t"))
    as_pred = pairs.select(*by, F.col("pred").alias("class"), F.lit(0).alias("i"), F.col("n").alias("p"), F.lit(0).alias("t")).where((F.col("class") >= 0) & (F.col("class") < classes))
    a = as_target.unionByName(as_pred).groupBy(*by, "class").agg(F.sum("i").alias("intersection"), F.sum("p").alias("predicted"), F.sum("t").alias("target"))
    return a.withColumn("union", F.col("predicted") + F.col("target") - F.col("intersection"))


def iou(a: DataFrame) -> DataFrame:
    return a.withColumn("iou", F.col("intersection") / (F.col("union") + 1e-8) + 1e-8).withColumn("exists", F.col("union") > 1e-3)


def all_metrics(df: DataFrame, classes: int) -> DataFrame:
    """One row: miou and macc over classes that exist, oa."""
    a = iou(areas(df, classes))
    return a.agg(
        F.avg(F.when(F.col("exists"), F.col("iou"))).alias("miou"),
        F.avg(F.when(F.col("target") > 0, F.col("intersection") / F.col("target"))).alias("macc"),
        (F.sum("intersection") / F.greatest(F.sum("target"), F.lit(1))).alias("oa"),
    )


def dense_metrics(df: DataFrame, classes: int) -> DataFrame:
    """One row: means over all classes, an absent one counting 0."""
    ids = df.sparkSession.range(classes).withColumnRenamed("id", "class")
    a = ids.join(areas(df, classes), "class", "left").na.fill(0)
    return a.agg(
        F.avg(F.col("intersection") / (F.col("union") + 1e-10)).alias("miou"),
        F.avg(F.col("intersection") / (F.col("target") + 1e-10)).alias("macc"),
        (F.sum("intersection") / (F.sum("target") + 1e-10)).alias("allacc"),
    )


def scene_iou(df: DataFrame, classes: int, by: str = "scene") -> DataFrame:
    """Per scene the mean over classes whose union isn't empty."""
    a = areas(df, classes, (by,))
    return a.where("union > 0").groupBy(by).agg(F.avg(F.col("intersection") / (F.col("union") + 1e-10)).alias("iou"))


def vote(scores: DataFrame, keys=("scene", "point_idx"), how: str = "sum") -> DataFrame:
    """(keys, pred): the class with the greatest sum (or mean) of scores over fragments or models, the least of equals."""
    s = scores.groupBy(*keys, "class").agg((F.sum if how == "sum" else F.avg)("score").alias("s"))
    return s.groupBy(*keys).agg(F.max_by("class", F.struct("s", -F.col("class"))).alias("pred"))


def evaluate_fragments(logits: DataFrame, truth: DataFrame, classes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Offline evaluation of test fragments: the points' voted classes, the scenes' IoU, and one row of metrics over all.

    ``logits``: scene, point_idx, fragment, class, logit; ``truth``: scene, point_idx, target.
    Each fragment votes with its softmax; a point takes the class with the greatest sum.
    """
    soft = log_softmax(logits, ["scene", "point_idx", "fragment"]).withColumn("score", F.exp("logp"))
    voted = vote(soft)
    both = truth.select("scene", "point_idx", "target").join(voted, ["scene", "point_idx"])
    return voted, scene_iou(both, classes), dense_metrics(both, classes)


def top_classes(scores: DataFrame, k: int = 3, keys=("scene", "point_idx")) -> DataFrame:
    """(keys, classes): the k best classes as text."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "class")
    t = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "class"))), lambda x: x["class"].cast("string"))
    return t.groupBy(*keys).agg(F.array_join(ordered, ",").alias("classes"))


def part_iou(df: DataFrame, parts: DataFrame) -> DataFrame:
    """Shapes' mean IoU over the parts of their category (shape, category; parts: category, part); an absent part in both counts 1."""
    t = df.groupBy("shape", F.col("target").alias("part")).agg(F.count("*").alias("t"), F.sum((F.col("target") == F.col("pred")).cast("long")).alias("i"))
    p = df.groupBy("shape", F.col("pred").alias("part")).agg(F.count("*").alias("p"))
    grid = df.select("shape", "category").distinct().join(parts, "category")
    g = grid.join(t, ["shape", "part"], "left").join(p, ["shape", "part"], "left").na.fill(0, ["t", "i", "p"])
    union = F.col("t") + F.col("p") - F.col("i")
    return g.groupBy("category", "shape").agg(F.avg(F.when(union == 0, F.lit(1.0)).otherwise(F.col("i") / union)).alias("iou"))


def parse_instances(df: DataFrame, ignore=(-1,)) -> DataFrame:
    """Per instance of labels that count: dense id, class less the vacated ones below it, centroid, box centre and size, points."""
    v = df.where(~F.col("segment").isin(*ignore) & (F.col("instance") >= 0))
    g = v.groupBy("scene", "instance").agg(F.min_by("segment", "point_idx").alias("segment"), F.count("*").alias("n"), *(f(c).alias(f"{p}{c}") for c in "xyz" for p, f in (("lo_", F.min), ("hi_", F.max), ("m_", F.avg))))
    dense = (F.row_number().over(Window.partitionBy("scene").orderBy("instance")) - 1).cast("long")
    below = sum(((F.lit(i) < F.col("segment")) & F.lit(i >= 0)).cast("long") for i in ignore)
    return g.select("scene", "instance", dense.alias("id"), (F.col("segment") - below).alias("class"), "n", *(((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2).alias(f"box_{c}") for c in "xyz"), *((F.col(f"hi_{c}") - F.col(f"lo_{c}")).alias(f"size_{c}") for c in "xyz"), *(F.col(f"m_{c}").alias(f"c{c}") for c in "xyz"))


def match_instances(gt: DataFrame, pred: DataFrame, least: int = 100) -> DataFrame:
    """(scene, gt, pred, class, intersection, gt_n, pred_n, iou, void) of overlapping instances of one class.

    ``gt``: scene, point_idx, instance, class (negative: void); ``pred``: scene, point_idx,
    proposal, class.  Proposals under ``least`` points are left out.
    """
    g = gt.where("class >= 0").groupBy("scene", "instance").agg(F.min_by("class", "point_idx").alias("class"), F.count("*").alias("gt_n"))
    p = pred.groupBy("scene", "proposal").agg(F.min("class").alias("pred_class"), F.count("*").alias("pred_n")).where(F.col("pred_n") >= least)
    both = pred.select("scene", "point_idx", "proposal").join(gt.select("scene", "point_idx", "instance", F.col("class").alias("_c")), ["scene", "point_idx"])
    void = both.groupBy("scene", "proposal").agg(F.sum((F.col("_c") < 0).cast("long")).alias("void"))
    n = both.where("_c >= 0").groupBy("scene", "instance", "proposal").agg(F.count("*").alias("intersection"))
    m = n.join(g, ["scene", "instance"]).join(p, ["scene", "proposal"]).where("class = pred_class").join(void, ["scene", "proposal"])
    return m.withColumn("iou", F.col("intersection") / (F.col("gt_n") + F.col("pred_n") - F.col("intersection"))).drop("pred_class")


def average_precision(matches: DataFrame, gt: DataFrame, proposals: DataFrame, ious=IOUS) -> DataFrame:
    """(class, iou, ap, n_gt) by greedy matching in falling confidence.

    ``matches`` as :func:`match_instances`, ``gt``: scene, instance, class, n; ``proposals``:
    scene, proposal, class, n, score, void.  A ground truth takes its most confident match;
    later ones are false positives; a proposal without a match counts as false unless more
    than the threshold of it is void.  AP is the area under the precision-recall curve over
    distinct scores with recall stepped by half its neighbours.  Null without ground truth.
    """
    t = gt.sparkSession.createDataFrame([(float(x),) for x in ious], "th double")
    m = matches.select("scene", "instance", "proposal", "class", "iou").join(proposals.select("scene", "proposal", "score"), ["scene", "proposal"]).join(F.broadcast(t), F.col("iou") > F.col("th"))
    w = Window.partitionBy("th", "class", "scene", "instance").orderBy(F.col("score").desc(), "proposal")
    hit = m.withColumn("first", F.row_number().over(w) == 1).groupBy("th", "class", "scene", "proposal").agg(F.max(F.col("first").cast("int")).alias("tp"), F.first("score").alias("score"))
    rest = proposals.join(F.broadcast(t), F.col("void") / F.col("n") <= F.col("th")).join(hit.select("th", "scene", "proposal"), ["th", "scene", "proposal"], "left_anti")
    e = hit.select("th", "class", "score", "tp").unionByName(rest.select("th", "class", "score", F.lit(0).alias("tp")))
    e = e.groupBy("th", "class", "score").agg(F.sum("tp").alias("tp"), F.count("*").alias("k"))
    down = Window.partitionBy("th", "class").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = gt.groupBy("class").agg(F.count("*").alias("n_gt"))
    c = e.withColumns({"ctp": F.sum("tp").over(down), "ck": F.sum("k").over(down)}).join(total, "class")
    c = c.withColumns({"precision": F.col("ctp") / F.col("ck"), "recall": F.col("ctp") / F.col("n_gt")})
    o = Window.partitionBy("th", "class").orderBy(F.col("score").desc())
    # Points in rising recall: precision 1 at recall 0 closes the curve.
    before, after = F.coalesce(F.lag("recall").over(o), F.lit(0.0)), F.coalesce(F.lead("recall").over(o), F.col("recall"))
    step = (after - before) / 2
    area = c.withColumn("part", F.col("precision") * step).withColumn("r0", F.when(F.lag("recall").over(o).isNull(), F.col("recall") / 2))
    ap = area.groupBy("th", "class").agg((F.sum("part") + F.coalesce(F.max("r0"), F.lit(0.0))).alias("ap"))
    grid = gt.select("class").unionByName(proposals.select("class")).distinct().join(total, "class", "left").withColumn("th", F.explode(F.array(*(F.lit(float(x)) for x in ious))))
    return grid.join(ap, ["th", "class"], "left").select("class", F.col("th").alias("iou"), F.when(F.col("n_gt") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"), F.coalesce("n_gt", F.lit(0)).alias("n_gt"))


def ap_summary(ap: DataFrame) -> DataFrame:
    """Means over classes with ground truth: ap (0.5 to 0.9), ap50, ap25."""
    return ap.agg(F.avg(F.when(F.col("iou") >= 0.5, F.col("ap"))).alias("ap"), F.avg(F.when(F.col("iou") == 0.5, F.col("ap"))).alias("ap50"), F.avg(F.when(F.col("iou") == 0.25, F.col("ap"))).alias("ap25"))


def weighted_mean(df: DataFrame, by: str, value: str, n: str) -> DataFrame:
    return df.groupBy(by).agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("avg"), F.sum(n).alias("count"))


def gradient_norm(df: DataFrame, value: str, by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def rolled_up(df: DataFrame, classes: int) -> DataFrame:
    """Counts and IoU of each class and, with a null class, of all together."""
    a = areas(df, classes).rollup("class").agg(*(F.sum(c).alias(c) for c in ("intersection", "predicted", "target", "union")))
    return a.withColumn("iou", F.col("intersection") / (F.col("union") + 1e-10))


def best_record(df: DataFrame, metric: str, by=()) -> DataFrame:
    """The row with the greatest metric, of each group if there are any; of equals that with the least other values."""
    rest = [c for c in df.columns if c != metric and c not in by]
    best = df.groupBy(*by).agg(F.min(F.struct((-F.col(metric)).alias("_m"), *rest)).alias("b"))
    return best.select(*by, (-F.col("b._m")).alias(metric), *(F.col(f"b.{c}").alias(c) for c in rest))
