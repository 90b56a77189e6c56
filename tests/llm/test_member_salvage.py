"""Damage inside a gzip member that holds many records."""

from __future__ import annotations

import random

from pointloom.llm import warc

from .test_join_operators import salvaged

RNG = random.Random(11)
RECORDS = [warc.record(i, f"http://h/{i}", RNG.randbytes(3000), "response", None) for i in range(30)]
IDS = [f"<urn:page:{i}>" for i in range(30)]


def test_a_wrong_digest_costs_one_record():
    bad = bytearray(RECORDS[7])
    bad[-10] ^= 0xFF
    data = warc.gzipped(b"".join([*RECORDS[:7], bytes(bad), *RECORDS[8:]]))
    after = warc.gzipped(RECORDS[0])
    got, gaps = salvaged(data + after)
    assert got == IDS[:7] + IDS[8:] + IDS[:1] and gaps == [(0, len(data))]
    why = next(w for *_, w, r in warc.salvage(_File(data), len(data)) if r is None)
    assert why.startswith(f"{len(bad)} bytes from {sum(map(len, RECORDS[:7]))} in the member: ")


def test_bad_records_at_both_ends():
    data = warc.gzipped(b"X" + b"".join(RECORDS[:3])[1:] + b"rest")
    assert salvaged(data)[0] == IDS[1:3] and len(salvaged(data)[1]) == 2


def test_a_cut_member_keeps_what_comes_before():
    data, one = warc.gzipped(b"".join(RECORDS)), warc.gzipped(RECORDS[0])
    for tail in (b"", one):
        got, _ = salvaged(data[: len(data) // 2] + tail)
        n = len(got) - bool(tail)
        assert n >= 13 and got == IDS[:n] + IDS[: bool(tail)]
    assert salvaged(data[:-5])[0] == IDS


def test_a_zlib_error_keeps_what_comes_before():
    data, one = bytearray(warc.gzipped(b"".join(RECORDS))), warc.gzipped(RECORDS[0])
    at = len(data) * 2 // 3
    data[at : at + 200] = bytes(RNG.randrange(256) for _ in range(200))
    got, gaps = salvaged(bytes(data) + one)
    assert got[:18] == IDS[:18] and got[-1] == IDS[0] and gaps


class _File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]
