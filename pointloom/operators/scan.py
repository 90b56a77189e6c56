"""Global ranks and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import _saved

_ROW = (1 << 33) - 1
#: Groups of up to so many rows are ordered in a task each, larger ones by ranges.
IN_A_TASK = 1_000_000
#: Rows that a task of an explicit shuffle gets on average.
ROWS_A_TASK = 50_000


def parts_for(rows: int) -> int:
    """As many partitions as the rows ask for."""
    return -(-rows // ROWS_A_TASK)


def prefix(df: DataFrame, *order: Column | str, rank: str = "rank", value: str | None = None, running: str = "running") -> DataFrame:
    """With ``rank`` from 0 in the given order and, for a value, its running sum up to and with the row.

    Rows are dealt by ranges of the order and sorted within them; each range counts and sums
    its own rows, and a window over one row per range carries the totals.  The ranges are
    saved first, since they are drawn from a sample.  They are as many as the rows ask for.
    """
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    d = df.repartitionByRange(max(1, parts_for(df.count())), *order).sortWithinPartitions(*order)
    d = _saved(d.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))}))
    per = d.groupBy("_range").agg(F.count("*").alias("_n"), *([F.sum(value).alias("_s")] if value else []))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0")] if value else []))
    out = d.join(F.broadcast(carry), "_range").withColumn(rank, F.col("_n0") + F.col("_at"))
    if value:
        out = out.withColumn(running, F.col("_s0") + F.sum(value).over(inside))
    return out.drop("_range", "_at", "_n0", "_s0")


def prefix_within(df: DataFrame, by: list[str], *order: Column | str, value: str, rank: str = "rank", running: str = "running", total: str = "total") -> DataFrame:
    """As :func:`prefix`, within groups; with the group's total of the value.

    For few groups of any size, such as classes: they are ranked as one order by group and
    then the given one, and one row per group tells where it starts.
    """
    d = prefix(df, *by, *order, rank=rank, value=value, running=running)
    per = df.groupBy(*by).agg(F.count("*").alias("_gn"), F.sum(value).alias(total))
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(*by, total, F.coalesce(F.sum("_gn").over(before), F.lit(0)).alias("_gn0"), F.coalesce(F.sum(total).over(before), F.lit(0)).alias("_gs0"))
    return d.join(start, by).withColumns({rank: F.col(rank) - F.col("_gn0"), running: F.col(running) - F.col("_gs0")}).drop("_gn0", "_gs0")


def all_small(df: DataFrame, by: list[str], most: int | None = None) -> bool:
    """Whether no group has more than ``most`` rows, so that each may be ordered in a task."""
    most = IN_A_TASK if most is None else most
    return df.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most).isEmpty()


def rank_within(df: DataFrame, by: list[str], *order: Column | str, rank: str = "rank", most: int | None = None, small: bool = False) -> DataFrame:
    """With ``rank``, from 0 in the given order within each group, for any number of groups of any size.

    Groups of up to ``most`` rows (:data:`IN_A_TASK`) are windows.  Larger ones are ranked as
    one order by group and then the given one (:func:`prefix`), less the least rank of the group.
    ``small``: the caller knows that there are none of these.
    """
    most = IN_A_TASK if most is None else most
    window = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    if small:
        return df.withColumn(rank, window.cast("long"))
    sizes = df.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most).select(*by)
    large = _saved(sizes)
    if large.isEmpty():
        return df.withColumn(rank, window.cast("long"))
    small = df.join(large, by, "left_anti").withColumn(rank, window.cast("long"))
    d = _saved(prefix(df.join(large, by, "left_semi"), *by, *order, rank=rank))
    first = d.groupBy(*by).agg(F.min(rank).alias("_first"))
    d = d.join(first, by).withColumn(rank, (F.col(rank) - F.col("_first")).cast("long")).drop("_first")
    return small.unionByName(d)


def among_least(df: DataFrame, by: list[str], value: str, tie: str, k: str, mark: str = "is_least", parts: int = 512, most: int | None = None, small: bool = False) -> DataFrame:
    """With ``mark``: whether a row is one of the ``k`` with the least values of its group, ties by ``tie``; ``k`` is a column that is constant in a group.

    The k-th value is enclosed between two values, of ``parts`` that a quantile summary gives,
    and rows below and between are counted exactly; again, until at most ``most`` rows are between or
    they can't be parted.  Rows below are taken without being ordered; only those between are
    ranked.  A round leaves some 4 in ``parts`` of the rows.  Where all groups have at most ``most``
    rows, which the caller may know (``small``), each is ordered in a task.
    """
    most = IN_A_TASK if most is None else most
    if small or all_small(df, by, most):
        return df.withColumn(mark, F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)) <= F.col(k))
    state = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_rows"), F.max(F.col(k).cast("long")).alias("_need"))
    wide = (F.col("_rows") > most) & (F.col("_lo") < F.col("_hi")) & (F.col("_need") > 0) & (F.col("_need") < F.col("_rows"))
    state = _saved(state.withColumn("_more", wide))
    v, quantiles = F.col(value), [i / parts for i in range(parts + 1)]
    while not state.where("_more").isEmpty():
        inside = df.select(*by, v.alias(value)).join(state.where("_more"), by).where(v.between(F.col("_lo"), F.col("_hi")))
        cuts = inside.groupBy(*by).agg(F.percentile_approx(value, quantiles, 8 * parts).alias("_q"), F.first("_need").alias("_need"), F.first("_rows").alias("_rows"))
        at = lambda i: F.element_at("_q", F.least(F.greatest(i, F.lit(1)), F.lit(parts + 1)).cast("int"))
        place = F.col("_need") / F.col("_rows") * parts + 1
        cuts = cuts.select(*by, at(F.floor(place) - 1).alias("_a"), at(F.ceil(place) + 1).alias("_b"))
        mid = v.between(F.col("_a"), F.col("_b"))
        n = inside.join(cuts, by).groupBy(*by).agg(
            *(F.first(c).alias(c) for c in ("_lo", "_hi", "_rows", "_need", "_a", "_b")), F.sum((v < F.col("_a")).cast("long")).alias("_below"), F.sum(mid.cast("long")).alias("_mid")
        )
        sure = (F.col("_below") < F.col("_need")) & (F.col("_need") <= F.col("_below") + F.col("_mid")) & (F.col("_mid") < F.col("_rows"))
        pick = lambda new, old: F.when(sure, new).otherwise(F.col(old)).alias(old)
        n = n.select(*by, pick(F.col("_a"), "_lo"), pick(F.col("_b"), "_hi"), pick(F.col("_mid"), "_rows"), pick(F.col("_need") - F.col("_below"), "_need"), sure.alias("_sure"))
        n = n.select(*by, "_lo", "_hi", "_rows", "_need", (F.col("_sure") & (F.col("_rows") > most) & (F.col("_lo") < F.col("_hi"))).alias("_more"))
        state = _saved(state.where("not _more").unionByName(n))
    d = df.join(state.drop("_rows", "_more"), by)
    edge = F.col(value).between(F.col("_lo"), F.col("_hi"))
    clear = d.where(~edge).withColumn(mark, F.col(value) < F.col("_lo"))
    ranked = rank_within(d.where(edge), by, value, tie, rank="_rank", most=most).withColumn(mark, F.col("_rank") < F.col("_need")).drop("_rank")
    return clear.unionByName(ranked).drop("_lo", "_hi", "_need")


def least(df: DataFrame, by: list[str], value: str, tie: str, k: str, parts: int = 512, most: int | None = None, small: bool = False) -> DataFrame:
    """The rows that :func:`among_least` marks."""
    return among_least(df, by, value, tie, k, "_least", parts, most, small).where("_least").drop("_least")
