"""Members of many zip archives as one file system."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import FileReader, FileSource, read_bytes


class ZipReader(FileReader):
    """Options: path; suffix of members; content (true)."""

    suffix = ".zip"

    def rows(self, paths):
        want, content = self.options.get("suffix", ""), self.options.get("content", "true") == "true"
        for path in paths:
            with zipfile.ZipFile(io.BytesIO(read_bytes(path))) as z:
                for m in z.infolist():
                    if not m.is_dir() and m.filename.endswith(want):
                        yield (path, m.filename, m.file_size, z.read(m) if content else None)


class ZipSource(FileSource):
    """``spark.read.format("zip_members")``: archive, name, size, content."""

    reader_class = ZipReader

    @classmethod
    def name(cls):
        return "zip_members"

    def schema(self):
        return "archive string, name string, size long, content binary"


def children(members: DataFrame, folder: str) -> DataFrame:
    """Distinct names directly below a folder."""
    head = folder.strip("/") + "/" if folder.strip("/") else ""
    rest = F.expr("substring(name, {0})".format(len(head) + 1))
    return members.where(F.col("name").startswith(head)).select(F.substring_index(rest, "/", 1).alias("child")).distinct()
