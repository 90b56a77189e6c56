"""Frames, sweeps, running statistics, interleaving and schedules."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scan import prefix


def fuse_frames(frames: DataFrame, steps: Sequence[int] = (0, -1, -2), label: str | None = None, ignore: int = -1) -> DataFrame:
    """For every frame the rows of the frames ``frame_no + k`` of its sequence, with k as ``time``; labels of other frames are ignored."""
    ids = frames.select("sequence", "frame_no").distinct()
    wanted = ids.withColumn("time", F.explode(F.array(*(F.lit(int(s)) for s in steps)))).withColumn("_from", F.col("frame_no") + F.col("time"))
    out = wanted.join(frames.withColumnRenamed("frame_no", "_from"), ["sequence", "_from"]).withColumnRenamed("_from", "from_frame")
    return out if label is None else out.withColumn(label, F.when(F.col("time") == 0, F.col(label)).otherwise(F.lit(ignore)))


def sweep_chain(frames: DataFrame, sweeps: int = 10, value: str = "event_id") -> DataFrame:
    """Each frame's ``sweeps - 1`` predecessors, nearest first; the first of the sequence stands in where the chain has ended."""
    w = Window.partitionBy("sequence").orderBy("frame_no")
    first = F.first(value).over(w)
    past = F.array(*(F.coalesce(F.lag(value, k).over(w), first) for k in range(1, sweeps)))
    return frames.withColumn("sweeps", past)


def frame_order(paths: DataFrame, path: str = "path") -> DataFrame:
    """Frames by the whole number that their file's stem is: ``frame_no`` within each folder; files with other stems, or beyond 64 bits, are left out."""
    f = paths.withColumns({"folder": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "stem": F.regexp_extract(path, r"(?:^|/)(\d+)(?:\.[^/]*)?$", 1).try_cast("long")}).where("stem is not null")
    w = Window.partitionBy("folder").orderBy("stem", path)
    return f.withColumn("frame_no", (F.row_number().over(w) - 1).cast("long"))


def sequence_bounds(frames: DataFrame) -> DataFrame:
    return frames.groupBy("sequence").agg(F.min("frame_no").alias("first_frame"), F.count("*").alias("n"))


def moving_median(df: DataFrame, k: int, by: str = "name", at: str = "iteration", value: str = "value") -> DataFrame:
    w = Window.partitionBy(by).orderBy(at).rowsBetween(-(k - 1), 0)
    return df.withColumns({"median": F.percentile(value, 0.5).over(w), "mean": F.avg(value).over(w)})


def running_mean(df: DataFrame, by: str = "name", at: str = "iteration", value: str = "value", n: Column | None = None) -> DataFrame:
    """The mean so far, weighted by ``n``."""
    w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.lit(1.0) if n is None else n
    return df.withColumn("avg", F.sum(F.col(value) * weight).over(w) / F.sum(weight).over(w))


def latest(df: DataFrame, k: int | None = None, by: str = "name", at: str = "iteration", value: str = "value") -> DataFrame:
    """Each name's last value, or the median of its last k."""
    if k is None:
        return df.groupBy(by).agg(F.max_by(value, at).alias("latest"), F.max(at).alias(at))
    w = Window.partitionBy(by).orderBy(F.col(at).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(by).agg(F.percentile(value, 0.5).alias("latest"), F.max(at).alias(at))


def best_so_far(df: DataFrame, by: str = "name", at: str = "iteration", value: str = "value") -> DataFrame:
    """With the best value so far and whether a row sets it: what keeps a best checkpoint."""
    w = Window.partitionBy(by).orderBy(at)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({"best": F.greatest(F.coalesce(before, F.col(value)), F.col(value)), "is_best": before.isNull() | (F.col(value) > before)})


def remaining_time(df: DataFrame, total: int, by: str = "name", at: str = "iteration", value: str = "value") -> DataFrame:
    """Remaining iterations times the mean time so far."""
    return running_mean(df, by, at, value).withColumn("eta", (F.lit(total) - F.col(at)) * F.col("avg"))


def wide(df: DataFrame, names: Sequence[str], at: str = "iteration", name: str = "name", value: str = "value") -> DataFrame:
    """One row for each iteration with a column for each name; names are given, so there is no pass to find them."""
    return df.groupBy(at).pivot(name, list(names)).agg(F.max_by(value, at))


def interleave(sources: Sequence[DataFrame], ratios: Sequence[int], key: str, total: int | None = None) -> DataFrame:
    """Rows of all sources in turns of ``ratios``; each source restarts until the first one has ended.

    Ranks are taken per source; the slot of the j-th row of source s is computed, so there is
    no loop over rows.  The first source decides the number of turns.
    """
    counts = [s.count() for s in sources] if total is None else None
    turns = -(-(counts[0] if counts else total) // ratios[0])
    period, out, before = sum(ratios), None, 0
    for i, (s, r) in enumerate(zip(sources, ratios)):
        ranked = prefix(s, key, rank="_j")
        n = counts[i] if counts else s.count()
        need = turns * r if i else n
        copies = ranked.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, -(-need // max(1, n)) - 1)).cast("long"))))
        j = F.col("_j") + F.col("_c") * n
        slots = copies.withColumn("_p", j).where(F.col("_p") < need).withColumns({"source": F.lit(i), "slot": F.floor(F.col("_p") / r) * period + before + F.col("_p") % r})
        part = slots.drop("_j", "_c", "_p")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        before += r
    return out


# Schedules: closed forms over range(total)


def steps(spark: SparkSession, total: int) -> DataFrame:
    return spark.range(total).withColumnRenamed("id", "step")


def multi_step(rates: Sequence[float], total: int, base: float, gamma: float = 0.1) -> Column:
    passed = sum(((F.col("step") >= int(r * total)).cast("int") for r in rates), F.lit(0))
    return base * F.pow(F.lit(gamma), passed)


def multi_step_warmup(rates: Sequence[float], total: int, base: float, gamma: float = 0.1, warmup: float = 0.05, scale: float = 1e-6) -> Column:
    s = F.col("step")
    factor = F.when(s <= warmup * total, 1.0 - (1.0 - s / (warmup * total)) * (1.0 - scale)).otherwise(F.lit(1.0))
    return multi_step(rates, total, base, gamma) * factor


def poly(total: int, base: float, power: float = 0.9) -> Column:
    return base * F.pow(1.0 - F.col("step") / (total + 1), F.lit(power))


def exponential(total: int, base: float, gamma: float = 0.9) -> Column:
    return base * F.pow(F.lit(gamma), F.col("step") / total)


def cosine(total: int, base: float, least: float = 0.0) -> Column:
    return least + (base - least) * (1.0 + F.cos(pi * F.col("step") / total)) / 2.0


def one_cycle(total: int, top: float, pct_start: float = 0.3, div: float = 25.0, final_div: float = 1e4, linear: bool = False) -> Column:
    """Up from top/div within the first share of steps, then down to top/div/final_div at the last."""
    s, up = F.col("step"), pct_start * total - 1
    low, last = top / div, top / div / final_div

    def between(a: float, b: float, p: Column) -> Column:
        return (b - a) * p + a if linear else b + (a - b) / 2.0 * (1.0 + F.cos(pi * p))

    return F.when(s <= up, between(low, top, s / up)).otherwise(between(top, last, (s - up) / (total - 1 - up)))


def cosine_warmup(total: int, base: float, final: float, warmup: int = 0, start: float = 0.0, freeze: int = 0) -> Column:
    """Frozen at 0, linear up, half a cosine down; ``final`` from ``total`` on."""
    s = F.col("step")
    rest = total - warmup - freeze
    down = final + 0.5 * (base - final) * (1.0 + F.cos(pi * (s - freeze - warmup) / rest))
    rise = start + (base - start) * (s - freeze) / max(1, warmup - 1)
    return F.when(s < freeze, 0.0).when(s < freeze + warmup, rise).when(s < total, down).otherwise(F.lit(final))


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, values: Sequence[str]) -> DataFrame:
    """Left rows with the values of the latest right row of their key at or before their time; null where there is none.

    Both sides are stacked and sorted once; no pairs are made.
    """
    a = left.withColumns({"_side": F.lit(1)} | {f"_{v}": F.lit(None).cast(dict(right.dtypes)[v]) for v in values})
    b = right.select(by, at, F.lit(0).alias("_side"), *(F.col(v).alias(f"_{v}") for v in values))
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_side") == 0, F.struct(*(f"_{v}" for v in values))), ignorenulls=True).over(w)
    d = a.unionByName(b, allowMissingColumns=True).withColumn("_h", held).where("_side = 1")
    return d.select(*left.columns, *(F.col(f"_h._{v}").alias(v) for v in values))
