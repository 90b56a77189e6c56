"""Losses and small forward passes as aggregates over long tables (point, class, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import prefix_within


def log_softmax(logits: DataFrame, keys: Sequence[str], value: str = "logit") -> DataFrame:
    """With ``logp``: the logarithm of the softmax over each key's rows, shifted by the greatest."""
    w = Window.partitionBy(*keys)
    d = logits.withColumn("_m", F.max(value).over(w))
    return d.withColumn("logp", F.col(value) - F.col("_m") - F.ln(F.sum(F.exp(F.col(value) - F.col("_m"))).over(w))).drop("_m")


def cross_entropy(logits: DataFrame, keys: Sequence[str], ignore: int = -1, smoothing: float = 0.0, weights: Column | None = None) -> DataFrame:
    """One row: the (weighted) mean of -log p of the target; with smoothing, mixed with the mean over all classes.

    ``logits``: keys, class, logit, target.
    """
    d = log_softmax(logits.where(F.col("target") != ignore), keys)
    w = F.lit(1.0) if weights is None else weights
    n = F.count("*").over(Window.partitionBy(*keys))
    d = d.withColumns({"_w": w, "_n": n})
    own = F.sum(F.when(F.col("class") == F.col("target"), -F.col("_w") * F.col("logp")).otherwise(0.0))
    total = F.sum(F.when(F.col("class") == F.col("target"), F.col("_w")).otherwise(0.0))
    even = F.sum(-F.col("_w") * F.col("logp") / F.col("_n"))
    return d.agg((((1 - smoothing) * own + smoothing * even) / total).alias("loss"))


def smooth_ce(logits: DataFrame, keys: Sequence[str], ignore: int = -1, eps: float = 0.1) -> DataFrame:
    """One row: the mean cross entropy against targets of 1-eps, and eps over the other classes."""
    d = log_softmax(logits.where(F.col("target") != ignore), keys)
    n = F.count("*").over(Window.partitionBy(*keys))
    d = d.withColumn("_n", n)
    weight = F.when(F.col("class") == F.col("target"), F.lit(1 - eps)).otherwise(F.lit(eps) / (F.col("_n") - 1))
    return d.agg((-F.sum(weight * F.col("logp")) / F.sum((F.col("class") == F.col("target")).cast("long"))).alias("loss"))


def sigmoid_ce(logit: Column, target: Column) -> Column:
    """Binary cross entropy with logits, stable on both sides."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def binary_focal(df: DataFrame, gamma: float = 2.0, alpha: float = 0.5) -> DataFrame:
    """One row: the mean of alpha-weighted focal loss of (logit, target in 0, 1)."""
    t = F.col("target").cast("double")
    bce = sigmoid_ce(F.col("logit"), t)
    a = alpha * t + (1 - alpha) * (1.0 - t)
    return df.agg(F.avg(a * F.pow(1.0 - F.exp(-bce), F.lit(gamma)) * bce).alias("loss"))


def focal(logits: DataFrame, keys: Sequence[str], classes: int, gamma: float = 2.0, alpha: float = 0.5, ignore: int = -1, reduction: str = "mean") -> DataFrame:
    """One row: per-class sigmoid focal loss over points that count: per point the sum over classes, then mean or sum."""
    d = logits.where(F.col("target") != ignore)
    t = (F.col("class") == F.col("target")).cast("double")
    p = 1.0 / (1.0 + F.exp(-F.col("logit")))
    miss = (1.0 - p) * t + p * (1.0 - t)
    a = alpha * t + (1 - alpha) * (1.0 - t)
    loss = F.sum(a * F.pow(miss, F.lit(gamma)) * sigmoid_ce(F.col("logit"), t))
    return d.agg((loss / F.count("*") * F.lit(classes) if reduction == "mean" else loss).alias("loss"))


def dice(logits: DataFrame, keys: Sequence[str], ignore: int = -1, smooth: float = 1.0, exponent: float = 2.0) -> DataFrame:
    """One row: the mean over classes of 1 - Dice of softmax scores, by two sums per class."""
    d = log_softmax(logits.where(F.col("target") != ignore), keys).withColumn("p", F.exp("logp"))
    t = (F.col("class") == F.col("target")).cast("double")
    per = d.groupBy("class").agg(F.sum(F.col("p") * t).alias("i"), F.sum(F.pow("p", F.lit(exponent)) + t).alias("u"))
    return per.agg(F.avg(1.0 - (2.0 * F.col("i") + smooth) / (F.col("u") + smooth)).alias("loss"))


def lovasz_terms(errors: DataFrame, by: Sequence[str], positive: bool = False) -> DataFrame:
    """(by, loss) of (by, id, error, fg): errors in falling order times the steps of the Jaccard index; with ``positive``, only errors above 0.

    A class may hold any share of the points, so ranks and running sums come from ranges of
    the order; the index one place before follows from them.
    """
    keys = ["_all", *by]
    d = prefix_within(errors.withColumn("_all", F.lit(1)), keys, F.col("error").desc(), "id", value="fg", rank="_k", running="_c", total="_g")
    index = lambda k, c: 1.0 - (F.col("_g") - c) / (F.col("_g") + k - c)
    before = F.when(F.col("_k") > 0, index(F.col("_k"), F.col("_c") - F.col("fg"))).otherwise(F.lit(0.0))
    step = index(F.col("_k") + 1, F.col("_c")) - before
    error = F.greatest("error", F.lit(0.0)) if positive else F.col("error")
    return d.withColumn("_t", error * step).groupBy(*keys).agg(F.sum("_t").alias("loss")).drop("_all")


def lovasz_softmax(logits: DataFrame, keys: Sequence[str], ignore: int = -1) -> DataFrame:
    """One row: the mean over classes that are present of the Lovasz extension of their errors."""
    d = log_softmax(logits.where(F.col("target") != ignore), keys)
    fg = (F.col("class") == F.col("target")).cast("double")
    e = d.select("class", F.struct(*keys).alias("id"), F.abs(fg - F.exp("logp")).alias("error"), fg.alias("fg"))
    present = e.groupBy("class").agg(F.sum("fg").alias("n")).where("n > 0").select("class")
    return lovasz_terms(e.join(present, "class"), ["class"]).agg(F.avg("loss").alias("loss"))


def lovasz_hinge(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Binary form on (id, logit, target in 0, 1): hinge errors, of which only positive ones count."""
    sign = 2.0 * F.col("target") - 1.0
    e = df.select(*by, "id", (1.0 - F.col("logit") * sign).alias("error"), F.col("target").cast("double").alias("fg"))
    return lovasz_terms(e, by, positive=True)


def offset_loss(df: DataFrame, ignore: int = -1) -> DataFrame:
    """One row: masked L1 and cosine losses of offsets (ox, oy, oz) against centroids (cx, cy, cz) of points (x, y, z)."""
    d = df.where(F.col("instance") != ignore)
    g = [F.col(f"c{c}") - F.col(c) for c in "xyz"]
    o = [F.col(f"o{c}") for c in "xyz"]
    l1 = F.abs(o[0] - g[0]) + F.abs(o[1] - g[1]) + F.abs(o[2] - g[2])
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) + 1e-8
    cos = (o[0] * g[0] + o[1] * g[1] + o[2] * g[2]) / (norm(o) * norm(g))
    return d.agg((F.sum(l1) / (F.count("*") + 1e-8)).alias("l1"), (-F.sum(cos) / (F.count("*") + 1e-8)).alias("cosine"))


def criteria(*parts: tuple[float, DataFrame]) -> DataFrame:
    """One row: the weighted sum of losses, each one row with ``loss``."""
    rows = [d.select((F.col("loss") * float(w)).alias("loss")) for w, d in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.agg(F.sum("loss").alias("loss"))


# Forward passes


def rope(feat: Column, gx: Column, gy: Column, gz: Column, dim: int, base: float = 100.0, inverse: bool = False) -> Column:
    """Rotary position embedding by three axes: each third of the channels turns by its coordinate, in pairs (d, d + dim/6)."""
    if dim % 6:
        raise ValueError("dim must be a multiple of 6")
    third, half = dim // 3, dim // 6
    out = []
    for axis, g in enumerate((gx, gy, gz)):
        for c in range(third):
            d = c % half
            angle = (g * (-1.0 if inverse else 1.0)) / float(base ** (d / half))
            a = F.element_at(feat, axis * third + d + 1)
            b = F.element_at(feat, axis * third + d + half + 1)
            out.append(a * F.cos(angle) - b * F.sin(angle) if c < half else b * F.cos(angle) + a * F.sin(angle))
    return F.array(*out)


def patch_attention(df: DataFrame, q: str = "q", k: str = "k", v: str = "v", scale: float = 1.0) -> DataFrame:
    """(scene, patch, slot, out): softmax attention of each slot over its patch; patches are of bounded size."""
    a = df.select("scene", "patch", "slot", F.col(q).alias("_q"))
    b = df.select("scene", "patch", F.col("slot").alias("_s"), F.col(k).alias("_k"), F.col(v).alias("_v"))
    dot = F.aggregate(F.zip_with("_q", "_k", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) * scale
    p = a.join(b, ["scene", "patch"]).withColumn("logit", dot)
    p = log_softmax(p, ["scene", "patch", "slot"])
    long = p.select("scene", "patch", "slot", F.exp("logp").alias("w"), F.posexplode("_v").alias("channel", "value"))
    s = long.groupBy("scene", "patch", "slot", "channel").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return s.groupBy("scene", "patch", "slot").agg(F.transform(F.sort_array(F.collect_list(F.struct("channel", "value"))), lambda x: x["value"]).alias("out"))


def linear(feat: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """weights x feat + bias, rows of weights being outputs."""
    dot = lambda row: F.aggregate(F.zip_with(feat, F.array(*(F.lit(float(w)) for w in row)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.array(*(dot(r) + float(bias[i] if bias is not None else 0.0) for i, r in enumerate(weights)))


def gelu(feat: Column) -> Column:
    """The tanh form of GELU, elementwise."""
    return F.transform(feat, lambda x: 0.5 * x * (1.0 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))))


def mlp(feat: Column, w1, b1, w2, b2) -> Column:
    return linear(gelu(linear(feat, w1, b1)), w2, b2)


def sparse_convolution(pairs: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """(scene, out, channel, value): sums over kernel pairs of weight[offset, channel, in_channel] x feature; ``features``: scene, voxel_id, feat."""
    f = features.select("scene", F.col("voxel_id").alias("in"), F.posexplode("feat").alias("in_channel", "v"))
    p = pairs.join(f, ["scene", "in"]).join(weights, ["offset", "in_channel"])
    return p.groupBy("scene", "out", "channel").agg(F.sum(F.col("v") * F.col("weight")).alias("value"))
