"""Packing by power-of-two decomposition: no sequence crosses documents, none is padded.

A document of n tokens is cut at the binary digits of n: as many pieces of the longest
length as fit, then one for each binary digit of the rest, longest first.  Each piece
is a sequence of its own; sequences of one length form a bucket, so a batch drawn from a
bucket has no padding.  The plan is one pass without a shuffle, whatever the skew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import id_text, map_batches, utf8
from .tokens import END_ID, WordTokens, default_path

MAX_LENGTH = 4096
SCHEMA = "doc_id long, start long, length long, doc_tokens long, bucket int, sequence_id long, offset long, ids binary"
#: Pieces of an Arrow batch hold about so many bytes of ids, and are at most so many.
OUT_BYTES, OUT_ROWS = 8 << 20, 8192
PER_BUCKET = 1 << 58
PER_PARTITION = 1 << 34


def lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """The pieces of n tokens: powers of two whose sum is n, longest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(it, path: str, longest: int):
    tokens = WordTokens.of(path)
    base = TaskContext.get().partitionId() * PER_PARTITION
    made = np.zeros(longest.bit_length() + 1, np.int64)
    rows: list[tuple] = []
    held = 0

    def batch():
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    for b in it:
        for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
            ids = np.append(tokens.ids(text), np.uint32(END_ID)).astype("<u4")
            start = 0
            for n in lengths(len(ids), longest):
                bucket = n.bit_length() - 1
                rows.append((doc, start, n, len(ids), bucket, bucket * PER_BUCKET + base + int(made[bucket]), 0, ids[start : start + n].tobytes()))
                made[bucket] += 1
                start += n
                held += 4 * n
                if held >= OUT_BYTES or len(rows) >= OUT_ROWS:
                    yield batch()
                    rows, held = [], 0
    if rows:
        yield batch()


def pack(documents: DataFrame, tokenizer: str | None = None, longest: int = MAX_LENGTH) -> DataFrame:
    """One row per piece: the document, where the piece starts in it, its length, bucket, sequence and ids.

    ``ids`` are little-endian unsigned 32-bit integers, ``bucket`` is log2 of the length,
    ``sequence_id`` is unique and its ids of one bucket lie in one range, ``offset`` is 0
    as a sequence has one piece.  A null or empty text is the end token alone.  Repeated
    rows are packed each by itself, null ids stay null, other columns are not read, and
    an empty table gives an empty result.  ``longest`` is a power of two.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    path = tokenizer or default_path()
    return map_batches(id_text(documents), lambda it: _pieces(it, path, longest), SCHEMA, ("tokens",))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
