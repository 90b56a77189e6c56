"""Scalars over steps as event files: a record for each step and name, as plotting tools read them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wire

# Field numbers of events and the version that files begin with.
EVENT = {"time": 1, "step": 2, "version": 3, "summary": 5}
VALUE = {"list": 1, "tag": 1, "number": 2}
VERSION = "brain.Event:2"


def _encoded(it):
    for b in it:
        rows = []
        for time, step, name, value in zip(*(c.to_pylist() for c in b.columns)):
            one = wire.put(VALUE["tag"], name) + wire.put_float(VALUE["number"], value)
            rows.append(wire.put(EVENT["time"], float(time)) + wire.put(EVENT["step"], step) + wire.put(EVENT["summary"], wire.put(VALUE["list"], one)))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])


def write_scalars(scalars: DataFrame, path: str) -> None:
    """Appends (name, iteration, value[, time]) to event files below a folder; a job that fails leaves none.

    Rows without a name, iteration or value are left out; values are kept in 32 bits.
    """
    time = F.coalesce(F.col("time").cast("double"), F.lit(0.0)) if "time" in scalars.columns else F.lit(0.0)
    d = scalars.select(time.alias("time"), F.col("iteration").cast("long").alias("step"), F.col("name").cast("string").alias("name"), F.col("value").cast("double").alias("value")).dropna(subset=["step", "name", "value"])
    begin = wire.put(EVENT["time"], 0.0) + wire.put(EVENT["version"], VERSION)
    d.mapInArrow(_encoded, "record binary").write.format("tfrecord").option("path", path).option("suffix", ".tfevents").option("first", begin.hex()).mode("append").save()


def _decoded(it):
    for b in it:
        rows = []
        for record in b.column(0):
            event = wire.message(record.as_buffer())
            for summary in event[EVENT["summary"]]:
                for v in map(wire.message, wire.message(summary)[VALUE["list"]]):
                    if v[VALUE["number"]]:
                        time = float(wire.floats(event[EVENT["time"]], "<f8")[-1]) if event[EVENT["time"]] else 0.0
                        step = wire.signed(event[EVENT["step"]][-1]) if event[EVENT["step"]] else 0
                        rows.append((bytes(v[VALUE["tag"]][-1]).decode("utf-8", "replace"), step, float(wire.floats(v[VALUE["number"]], "<f4")[-1]), time))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=["name", "iteration", "value", "time"])


def read_scalars(spark: SparkSession, path: str) -> DataFrame:
    """(name, iteration, value, time) of all event files below a folder; damaged records and events of other kinds are passed over."""
    records = spark.read.format("tfrecord").option("path", path).load().where("record is not null").select("record")
    return records.mapInArrow(_decoded, "name string, iteration long, value double, time double")
