"""Plain files in a folder that all executors share, by any address Arrow's file systems know."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    for old, new in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = uri.replace(old, new) if uri.startswith(old) else uri
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("hdfs:") else (fs.LocalFileSystem(), uri)


def open_in(uri: str):
    system, path = _system(uri)
    return system.open_input_file(path)


def open_out(uri: str):
    system, path = _system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def local_path(uri: str) -> str | None:
    """The path of a file on a mounted folder, None in other stores."""
    system, path = _system(uri)
    return path if isinstance(system, fs.LocalFileSystem) else None


def size_of(uri: str) -> int:
    system, path = _system(uri)
    return system.get_file_info(path).size


class Rolling:
    """Files of about ``limit`` bytes under a folder.  Each attempt of a task has its own names.

    Only names that a finished attempt has returned count, so a lost or repeated attempt
    leaves an unused file at most.
    """

    def __init__(self, folder: str, suffix: str, limit: int):
        self.folder, self.suffix, self.limit = folder.rstrip("/"), suffix, limit
        self.stem, self.n, self.file, self.uri = uuid.uuid4().hex, 0, None, None

    def room(self) -> str:
        """The file that the next write goes to; begins one if there is none or it is full."""
        if self.file is None or self.file.tell() >= self.limit:
            self.close()
            system, folder = _system(self.folder)
            system.create_dir(folder, recursive=True)
            name = f"{self.stem}-{self.n}{self.suffix}"
            self.n += 1
            self.file, self.uri = system.open_output_stream(f"{folder}/{name}", compression=None), f"{self.folder}/{name}"
        return self.uri

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None
