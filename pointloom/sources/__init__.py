"""Readers and writers of point-cloud files.

Formats are Python data sources (``npy_scene``, ``ply``, ``fixed_binary``, ``sens``,
``zip_members``, ``tfrecord``); call :func:`register` once per session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .binary import FixedBinarySource
from .npy import NpySceneSource
from .ply import PlySource
from .sens import SensSource
from .tfrecord import TfRecordSource
from .zips import ZipSource

SOURCES = [NpySceneSource, PlySource, FixedBinarySource, SensSource, ZipSource, TfRecordSource]


def register(spark: SparkSession) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)
