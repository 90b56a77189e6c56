"""Files by any address that Arrow's file systems know."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def listing(uri: str, suffix: str = "") -> list[str]:
    """Files below a folder by suffix, sorted; the file itself where the address is one."""
    s, path = system(uri)
    if s.get_file_info(path).type == fs.FileType.File:
        return [uri]
    found = s.get_file_info(fs.FileSelector(path, recursive=True))
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


def read_bytes(uri: str) -> bytes:
    s, path = system(uri)
    with s.open_input_file(path) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    s, path = system(uri)
    s.create_dir(path.rpartition("/")[0], recursive=True)
    with s.open_output_stream(path, compression=None) as f:
        f.write(data)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class FileReader(DataSourceReader):
    """One partition per file, or per group of files that belong together."""

    suffix = ""

    def __init__(self, options: dict, schema=None):
        self.options, self.schema = options, schema

    def groups(self) -> list[list[str]]:
        return [[p] for p in listing(self.options["path"], self.suffix)]

    def partitions(self):
        return [Files(g) for g in self.groups()] or [Files([])]

    def rows(self, paths: list[str]) -> Iterator:
        raise NotImplementedError

    def read(self, partition):
        if partition.paths:
            yield from self.rows(partition.paths)


class FileSource(DataSource):
    reader_class = FileReader

    def reader(self, schema):
        return self.reader_class(self.options, schema)
