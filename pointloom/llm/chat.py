"""Chat formatting over reply trees, in DataFrame operations alone.

Messages form trees by parent.  Self-joins that double their reach enumerate every
root-to-leaf path by its leaf (root, length, score); branches are ranked by score, and
the messages of each chosen path are marked by the same doubled steps and formatted as one
conversation.  Each round joins rows of constant size, and only those whose path has not
reached its root; there are log2(depth) rounds.

Template, per turn:  ``### Role: text </turn>\\n``.  In roles and texts a backslash is
written ``\\b``, ``#`` is ``\\h``, ``<`` is ``\\l`` and, in roles, ``:`` is ``\\c``; so no text
holds a control string, and reading back is exact.  The loss mask is the assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import checkpointed, written

OPEN, MID, CLOSE = "### ", ": ", " </turn>\n"
_ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    for raw, code in _ESCAPES:
        c = _replace(c, raw, code)
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(_ESCAPES):
        c = _replace(c, code, raw)
    return c


def linear_tree(conversations: DataFrame) -> DataFrame:
    """Conversations told by turn as trees: each row answers the row before it.

    Rows with one conv_id and turn are ordered by role, then text.  Nodes are numbered in
    that order.  Rows without conv_id belong to no conversation and are left out.  A
    conversation is one output row, so its rows meet in one task by nature.
    """
    from pyspark.sql import Window

    conversations = conversations.where("conv_id is not null")
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    c = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text", F.row_number().over(w).cast("long").alias("node"))
    return c.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def leaf_paths(nodes: DataFrame, rounds: int = 40) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, leaf, length, score) of every root-to-leaf path, and the ancestor tables that were built on the way.

    Table k holds (tree, node, up), the ancestor 2^k steps up, for nodes that have one.
    """
    n = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("s"))
    known = n.select("tree", F.col("node").alias("parent"))
    # A parent that does not exist makes its child a root.
    n = n.join(known.withColumn("has", F.lit(True)), ["tree", "parent"], "left").select("tree", "node", F.when(F.col("has"), F.col("parent")).alias("up"), F.col("s").alias("score"), F.lit(1).cast("long").alias("length"))
    at, tables = checkpointed(n), []
    for _ in range(rounds):
        open_rows = at.where("up is not null")
        if open_rows.isEmpty():
            break
        tables.append(open_rows.select("tree", "node", "up"))
        above = at.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("length").alias("length2"))
        longer = open_rows.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("length") + F.col("length2")).alias("length"))
        at = checkpointed(at.where("up is null").unionByName(longer))
    else:
        raise ValueError("the messages hold a cycle")
    inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    return at.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "length", "score"), tables


def choose(paths: DataFrame, branches: int | None = 1) -> DataFrame:
    """The best paths of each tree: by mean score, then length, then the least leaf; all of them if ``branches`` is None.

    The single best path is an aggregate with partial sums, so a tree with very many leaves is no hot key.
    """
    mean = F.col("score") / F.col("length")
    if branches == 1:
        best = F.max_by(F.struct("leaf", "length", "score"), F.struct(mean, "length", -F.col("leaf")))
        return paths.groupBy("tree").agg(best.alias("b")).select("tree", "b.leaf", "b.length", "b.score", F.lit(1).alias("rank"))
    from pyspark.sql import Window

    w = Window.partitionBy("tree").orderBy(mean.desc(), F.col("length").desc(), "leaf")
    ranked = paths.withColumn("rank", F.row_number().over(w))
    return ranked if branches is None else ranked.where(F.col("rank") <= branches)


def on_paths(chosen: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(tree, leaf, node, back) for every message on each chosen path; ``back`` counts steps from the leaf."""
    marked = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(tables))):
        up = marked.join(tables[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        marked = checkpointed(marked.unionByName(up))
    return marked


def format_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, leaf, rank, formatted, loss_spans, n_turns: each chosen path as one conversation.

    ``nodes`` has tree, node, parent, role, text, score.  ``loss_spans`` are (at, chars),
    1-based code points of the assistant texts within ``formatted``.  Null roles and texts
    are empty.  Ids are unique within a tree (of repeats each is formatted); an empty table
    gives an empty result; other columns are not read.  A formatted conversation is one
    string, so it must fit a row.
    """
    nodes = written(nodes.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score"), "reply-nodes")
    paths, tables = leaf_paths(nodes)
    chosen = choose(paths, branches)
    rows = on_paths(chosen, tables).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = _replace(escape(F.col("role")), ":", "\\c"), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(MID))
    turn = F.struct((-F.col("back")).alias("o"), F.concat(head, text, F.lit(CLOSE)).alias("s"), F.length(head).cast("long").alias("h"), F.length(text).cast("long").alias("t"), (F.col("role") == "assistant").alias("a"))
    grouped = rows.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # Starts of turns: sums over the sorted turns, as prefix sums of an array.
    size = lambda x: x["h"] + x["t"] + len(CLOSE)
    step = lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.when(x["a"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["h"] + 1).alias("at"), x["t"].alias("chars"))))).otherwise(acc["spans"]).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,chars:bigint>>").alias("spans"))
    out = grouped.select("tree", "leaf", F.array_join(F.transform("turns", lambda x: x["s"]), "").alias("formatted"), F.aggregate("turns", zero, step)["spans"].alias("loss_spans"), F.size("turns").cast("long").alias("n_turns"))
    return out.join(chosen.select("tree", "leaf", "rank"), ["tree", "leaf"])


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    parts = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    role = lambda x: F.substring_index(F.substring(x, len(OPEN) + 1, F.length(x)), MID, 1)
    return F.transform(parts, lambda x: F.struct(unescape(_replace(role(x), "\\c", ":")).alias("role"), unescape(F.substring(x, F.length(role(x)) + len(OPEN) + len(MID) + 1, F.length(x))).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what its output says when read back.

    Null roles and texts were formatted as empty; turns with equal numbers stand in the order of
    role and text, repeated ones each by itself; a conversation without turns has no row.
    """
    f = formatted.select(F.col("tree").alias("conv_id"), "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["at"].cast("int"), s["chars"].cast("int")))), "")
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
