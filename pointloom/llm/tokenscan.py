"""Token counts of flat, unindexed token files by a separator scan.

A file is a run of fixed-width token ids; a separator id ends each document.  Files are
read in blocks; each block is searched for the separator in one vectorised comparison.
Documents that cross blocks are stitched by a prefix scan over the blocks' summaries
(separators before, end of the last one before), which has one narrow row per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import Rolling, open_in, size_of
from .frames import drop_paths, id_text, map_batches, new_path, utf8, written
from .tokens import WordTokens, default_path

SEPARATOR = 65_535  # beyond the vocabulary, so that no text yields it, not even one with its <|endoftext|>
WIDTH = 2
BLOCK_BYTES = 8 << 20
FILE_BYTES = 64 << 20
#: Blocks that the prefix scan takes together, and tasks of a search at most.
GROUP, MOST_TASKS = 4096, 50_000


def _write(it, path: str, folder: str, separator: int, width: int, limit: int):
    tokens, out = WordTokens.of(path), Rolling(folder, ".tok", limit)
    kind, last, ordinal = f"<u{width}", None, 0
    for b in it:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
            uri = out.room()
            ordinal, last = (ordinal + 1, uri) if uri == last else (0, uri)
            ids = tokens.ids(text)
            if len(ids) and ((ids == separator).any() or int(ids.max()) >> 8 * width):
                raise ValueError("a text's token is the separator, or wider than the file's ids")
            out.write(np.append(ids, np.uint32(separator)).astype(kind).tobytes())
            rows.append((uri, ordinal, doc))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, [pa.string(), pa.int64(), pa.int64()])], names=["path", "ordinal", "doc_id"])
    out.close()


def write_tokens(documents: DataFrame, folder: str, tokenizer: str | None = None, separator: int = SEPARATOR, width: int = WIDTH, limit: int = FILE_BYTES) -> DataFrame:
    """Write every text's ids and the separator to files in ``folder``; returns (path, ordinal, doc_id), a table already written.

    A null or empty text is the separator alone.  Repeated rows are documents of their own.
    Every token is written; a separator that a text's tokens contain is an error.
    """
    path = tokenizer or default_path()
    return written(map_batches(id_text(documents), lambda it: _write(it, path, folder, separator, width, limit), "path string, ordinal long, doc_id long", ("tokens",)), "token-files")


def _sizes(it):
    for b in it:
        paths = b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([size_of(p) for p in paths], pa.int64())], names=["path", "bytes"])


_FOUND = pa.schema([("path", pa.string()), ("block", pa.int64()), ("i", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("k", pa.int64()), ("stop", pa.int64())])
_FOUND_SQL = "path string, block long, i long, start long, end long, k long, stop long"
#: Rows of a batch that a search yields.
_OUT_ROWS = 1 << 16


def _search(it, separator: int, width: int):
    """One row per separator: where its document starts, null for the first of a block, and ends.

    Before them one row per block with i = -1: its separators (k), the place after its last one (start) and its end (stop).
    """
    for b in it:
        for path, block, at, n in zip(*(c.to_pylist() for c in b.columns)):
            with open_in(path) as f:
                data = f.read_at(n, at)
            first, tokens = at // width, len(data) // width
            ends = np.flatnonzero(np.frombuffer(data, f"<u{width}", tokens) == separator) + first
            last = int(ends[-1]) + 1 if len(ends) else None
            yield pa.RecordBatch.from_pylist([{"path": path, "block": block, "i": -1, "start": last, "k": len(ends), "stop": first + tokens}], _FOUND)
            for lo in range(0, len(ends), _OUT_ROWS):
                part = ends[lo : lo + _OUT_ROWS]
                starts = np.empty(len(part), np.int64)
                starts[1:] = part[:-1] + 1
                starts[0] = ends[lo - 1] + 1 if lo else 0
                unknown = np.zeros(len(part), bool)
                unknown[0] = not lo
                none = pa.nulls(len(part), pa.int64())
                name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), pa.array([path])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(np.full(len(part), block, np.int64)), pa.array(np.arange(lo, lo + len(part))), pa.array(starts, mask=unknown), pa.array(part), none, none], schema=_FOUND)


def _carry(blocks: DataFrame) -> DataFrame:
    """The prefix scan over blocks (path, block, k, last, stop): documents before each, where its first begins, and whether it is the file's last.

    A file's blocks are scanned in groups of ``GROUP``: within each, then over one row per group.
    So no window holds more than a group, or a file's groups.
    """
    d = blocks.withColumn("g", F.floor(F.col("block") / GROUP))
    inside = Window.partitionBy("path", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", F.coalesce(F.sum("k").over(inside), F.lit(0)).alias("k0"), F.max("last").over(inside).alias("open0"))
    groups = blocks.withColumn("g", F.floor(F.col("block") / GROUP)).groupBy("path", "g").agg(F.sum("k").alias("gk"), F.max("last").alias("glast"), F.max("block").alias("most"))
    over = Window.partitionBy("path").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("path", "g", F.coalesce(F.sum("gk").over(over), F.lit(0)).alias("gk0"), F.max("glast").over(over).alias("gopen"), F.max("most").over(Window.partitionBy("path")).alias("most"))
    both = d.join(groups, ["path", "g"])
    return both.select("path", "block", (F.col("gk0") + F.col("k0")).alias("ordinal0"), F.coalesce("open0", "gopen", F.lit(0)).alias("open"), (F.col("block") == F.col("most")).alias("is_last"), "k", "last", "stop")


def scan(spark: SparkSession, files: DataFrame, separator: int = SEPARATOR, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, start, n_tokens, ended) of every document in the files named by ``path``.

    ``start`` and ``n_tokens`` count tokens, without separators.  Tokens after a file's last
    separator are a document with ``ended`` false.  Empty files have no documents; repeated
    paths and nulls are read once or not at all; bytes beyond the last whole token are left out.
    Each document is a row from the search on, so blocks of very many short ones are spread
    like all others.
    """
    step = max(width, block_bytes // width * width)
    scratch: list[str] = []
    paths = written(files.select("path").where("path is not null").distinct(), "token-paths", scratch)
    n = max(1, paths.count())
    sized = map_batches(paths.repartition(min(n, 2000)), _sizes, "path string, bytes long")
    cut = sized.withColumn("bytes", F.col("bytes") - F.col("bytes") % width).where("bytes > 0")
    blocks = cut.select("path", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("block", "at"), "bytes")
    blocks = blocks.select("path", F.col("block").cast("long").alias("block"), "at", F.least(F.lit(step), F.col("bytes") - F.col("at")).alias("n"))
    tasks = min(max(n, spark.sparkContext.defaultParallelism), MOST_TASKS)
    found = written(map_batches(blocks.repartition(tasks), lambda it: _search(it, separator, width), _FOUND_SQL), "token-ends")
    drop_paths(spark, scratch)
    summed = found.where("i < 0").select("path", "block", "k", F.col("start").alias("last"), "stop")
    carry = _carry(summed)
    docs = found.where("i >= 0").select("path", "block", "i", "start", "end").join(carry.select("path", "block", "ordinal0", "open"), ["path", "block"])
    docs = docs.select("path", (F.col("ordinal0") + F.col("i")).alias("ordinal"), F.coalesce("start", "open").alias("start"), "end")
    # After a file's last separator: from there, or from where the scan says, to the file's end.
    tail = carry.where("is_last").select("path", (F.col("ordinal0") + F.col("k")).alias("ordinal"), F.coalesce("last", "open").alias("start"), "stop").where("start < stop")
    ended = docs.select("path", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    return ended.unionByName(tail.select("path", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))


def document_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ended) by way of token files: written, scanned without an index, and named again by their order.

    A null or empty text has no tokens; repeated rows and rows without a doc_id are counted each
    by itself; whole texts count, however long; other columns are not read; an empty table gives
    an empty result.
    """
    spark = documents.sparkSession
    named = write_tokens(documents, new_path(spark, "tokens"))
    return scan(spark, named).join(named, ["path", "ordinal"]).select("doc_id", "n_tokens", "ended")
