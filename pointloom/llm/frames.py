"""What the operators share on the Spark side: tables, the shared folder, Arrow maps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .caches import claim, give_back

#: Rows that an operator is handed at a time.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where the session has none."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shared-")  # one machine, as in tests
    sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, scratch: list[str] | None = None) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends here and nothing is computed again.

    Its path is added to ``scratch``, for :func:`drop_paths` when nothing reads it any more.
    """
    path = new_path(df.sparkSession, what)
    if scratch is not None:
        scratch.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, tables: tuple[str, ...] = ()) -> DataFrame:
    """``mapInArrow`` over slices of at most ``BATCH_ROWS`` rows.

    Spark bounds the batches themselves by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``,
    64 MB where the session says nothing else), so a worker holds that much, or one row.
    ``tables`` names the cached tables that ``f`` uses; a worker drops all others first.
    """

    def sliced(it):
        for b in it:
            for at in range(0, b.num_rows, BATCH_ROWS):
                yield b.slice(at, BATCH_ROWS)

    def run(it):
        claim(*tables)
        try:
            yield from f(sliced(it))
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def utf8(column) -> list:
    """An Arrow string column as bytes objects and None."""
    t = column.type
    return column.cast(pa.large_binary() if pa.types.is_large_string(t) else pa.binary()).to_pylist()


def id_text(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, whatever else the table has."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
