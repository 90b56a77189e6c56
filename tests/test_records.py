"""Record files, the wire format and lidar frames: damage, splits, commit, geometry."""

from __future__ import annotations

import math
import os
import random
import struct

import numpy as np
import pytest

from pointloom.sources import tfrecord, waymo, wire


def brute_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    assert tfrecord.crc32c(b"123456789") == 0xE3069283  # the published check value
    rng = random.Random(1)
    for n in (0, 1, 1023, 1024, 1025, 3 * 1024 + 7, 9000):
        data = rng.randbytes(n)
        assert tfrecord.crc32c(data) == brute_crc(data) == tfrecord.crc32c(memoryview(data))


def load(spark, path, **options):
    return spark.read.format("tfrecord").options(path=str(path), **options).load()


@pytest.fixture(scope="module")
def register(spark):
    spark.dataSource.register(tfrecord.TfRecordSource)


def written_file(path, records, change=lambda b: b) -> list[int]:
    data, starts = bytearray(), []
    for r in records:
        starts.append(len(data))
        data += tfrecord.framed(r)
    path.write_bytes(bytes(change(data)))
    return starts


def test_damage_is_logged_and_skipped(spark, register, tmp_path):
    rng = random.Random(2)
    records = [rng.randbytes(rng.choice([0, 1, 50, 3000])) for _ in range(40)]

    def change(data):
        at = starts
        data[at[5] + 13 if len(records[5]) > 1 else at[5] + len(records[5]) + 13] ^= 1  # data or their checksum
        data[at[9] + 2] ^= 255  # a length
        data[at[10] + 9] ^= 255  # and the next one's checksum
        return data[: at[39] + 5]  # the last breaks off

    starts = written_file(tmp_path / "a", records)
    written_file(tmp_path / "a", records, change)
    for split in (1 << 30, 5000, 700, 64):
        rows = sorted(load(spark, tmp_path / "a", split_bytes=split).collect(), key=lambda r: r["at"])
        assert [bytes(r.record) for r in rows if r.kind == "record"] == [r for i, r in enumerate(records) if i not in (5, 9, 10, 39)]
        gaps = [(r["at"], r.n_bytes, r.reason) for r in rows if r.kind == "gap"]
        assert gaps[0] == (starts[5], starts[6] - starts[5], "the data's checksum differs")
        assert gaps[1] == (starts[9], starts[11] - starts[9], "the length's checksum differs")
        assert gaps[2][0] == starts[39] and gaps[2][1] == 5 and len(gaps) == 3
        assert sum(r.n_bytes for r in rows) == starts[39] + 5


def test_heads_are_found_in_noise():
    data = os.urandom(5000) + tfrecord.framed(b"x" * 30) + os.urandom(100)
    assert 5000 in tfrecord.heads_in(data).tolist() and len(tfrecord.heads_in(data)) <= 2
    assert tfrecord.heads_in(b"short").tolist() == []


def test_empty_and_missing(spark, register, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    assert load(spark, tmp_path / "empty").count() == 0
    (tmp_path / "junk").write_bytes(b"nothing of a record")
    assert [(r.kind, r.n_bytes) for r in load(spark, tmp_path / "junk").collect()] == [("gap", 19)]


def test_writing_commits_all_or_nothing(spark, register, tmp_path):
    folder = tmp_path / "out"
    df = spark.range(0, 1000, 1, 7).selectExpr("cast(repeat(cast(id as string), 30) as binary) as record")
    for times in (1, 2):
        df.write.format("tfrecord").option("path", str(folder)).mode("append").save()
        assert sorted(bytes(r.record) for r in load(spark, folder).collect()) == sorted((str(i) * 30).encode() for i in range(1000) for _ in range(times))
    before = sorted(os.listdir(folder))
    assert all(n.startswith("part-") for n in before)
    bad = spark.range(0, 1000, 1, 7).selectExpr("cast(if(id = 990, raise_error('stop'), 'x') as binary) as record")
    with pytest.raises(Exception):
        bad.write.format("tfrecord").option("path", str(folder)).mode("append").save()
    assert sorted(os.listdir(folder)) == before
    spark.createDataFrame([(None,)], "record binary").write.format("tfrecord").option("path", str(folder)).mode("append").save()
    assert sorted(os.listdir(folder)) == before


def test_wire_format():
    m = wire.put(1, 300) + wire.put(2, -1) + wire.put(3, 1.5) + wire.put(4, "é") + wire.number(5 << 3 | wire.FOUR) + struct.pack("<f", 2.5)
    got = wire.message(m)
    assert got[1] == [300] and wire.signed(got[2][0]) == -1 and wire.floats(got[3], "<f8").tolist() == [1.5] and bytes(got[4][0]) == "é".encode() and wire.floats(got[5], "<f4").tolist() == [2.5]
    assert wire.varints([7, memoryview(wire.number(300) + wire.number(2)), memoryview(b"\x01\x02")]).tolist() == [7, 300, 2, 1, 2]
    for broken in (b"\x80", m[:-1], b"\x0b"):
        with pytest.raises(ValueError):
            list(wire.fields(broken))


def brute_place(r, row, column, height, width, inclinations, m, own=None, pose=None):
    """A pixel's place by plain trigonometry and matrices."""
    azimuth = (2 * (width - column - 0.5) / width - 1) * math.pi - math.atan2(m[1][0], m[0][0])
    p = [r * math.cos(azimuth) * math.cos(inclinations[row]), r * math.sin(azimuth) * math.cos(inclinations[row]), r * math.sin(inclinations[row]), 1]
    p = np.array(m) @ p
    if own is not None:
        a, b, c = own[:3]
        x = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
        y = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
        z = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
        p = np.linalg.inv(np.array(pose)) @ [*(z @ y @ x @ p[:3] + own[3:]), 1]
    return p[:3]


def frame(rng, lasers=(1, 2, 4), labels=True, height=3, width=5):
    turn = lambda a, t: [math.cos(a), -math.sin(a), 0, t, math.sin(a), math.cos(a), 0, -t, 0, 0, 1, 2 * t, 0, 0, 0, 1]
    out = []
    for laser in lasers:
        image = lambda: rng.uniform(-20, 50, (height, width, 4)).astype(np.float32)
        first = {"ranges": image()} | ({"pixel_pose": rng.uniform(-1, 1, (height, width, 6)).astype(np.float32), "labels": rng.integers(0, 400, (height, width, 2))} if laser == 1 else {})
        if not labels:
            first.pop("labels", None)
        limits = {"inclinations": sorted(rng.uniform(-0.4, 0.3, height))} if laser == 1 else {"least": -0.5, "most": 0.25}
        out.append({"laser": laser, "extrinsic": turn(laser * 0.4, laser), "returns": [first, {"ranges": image()} if laser != 4 else None]} | limits)
    return turn(0.3, 7.0), out


def test_points_of_frames(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for n, with_labels in ((0, True), (1, False)):
        pose, lasers = frame(rng, labels=with_labels)
        rows.append((waymo.frame_record(f"c{n}", 1000 + n, pose, lasers),))
        at = 0
        for return_no in (1, 2):
            for x in lasers:
                image = x["returns"][return_no - 1]
                if image is None:
                    continue
                h, w, _ = image["ranges"].shape
                inclinations = (x.get("inclinations") or [(i + 0.5) / h * 0.75 - 0.5 for i in range(h)])[::-1]
                own = x["returns"][0].get("pixel_pose")
                for row in range(h):
                    for column in range(w):
                        r = image["ranges"][row, column]
                        if r[0] > 0:
                            place = brute_place(float(r[0]), row, column, h, w, inclinations, np.reshape(x["extrinsic"], (4, 4)), None if own is None else own[row, column].astype(float), np.reshape(pose, (4, 4)))
                            label = image["labels"][row, column] if "labels" in image else (0, 0)
                            want.append((f"c{n}", at, x["laser"], return_no, *np.round(place, 6), *(float(v) for v in r[:3]), int(label[1]), int(label[0])))
                            at += 1
    records = spark.createDataFrame([*rows, (None,)], "record binary")
    got = waymo.points(waymo.images(records)).orderBy("context", "point_idx").collect()
    assert len(got) == len(want) > 50
    for g, w in zip(got, want):
        assert (g.context, g.point_idx, g.laser, g.return_no, g.range, g.intensity, g.elongation, g.segment, g.instance) == (*w[:4], *w[7:])
        assert np.allclose([g.x, g.y, g.z], w[4:7], atol=1e-5)
    assert {r.context for r in waymo.images(records, labelled=True).collect()} == {"c0"}
    assert waymo.points(waymo.images(records.where("false"))).count() == 0


def test_a_frame_without_calibration_or_images():
    assert waymo.images_of(waymo.frame_record("x", -5, [1.0] * 16, [])) == []
    body = waymo.frame_record("x", -5, [], [{"laser": 2, "extrinsic": np.eye(4).ravel(), "inclinations": [0.1], "returns": [{"ranges": np.ones((1, 2, 3), np.float32)}, None]}])
    (one,) = waymo.images_of(body)
    assert (one["timestamp"], one["channels"], one["n_points"], one["inclinations"]) == (-5, 3, 2, [0.1])


def test_scalars_in_event_files(spark, register, tmp_path):
    from pointloom.sources import events

    rows = [("loss", i, i / 8, 100.0 + i) for i in range(50)] + [("é/acc", -3, -0.25, None), (None, 1, 1.0, 0.0), ("x", None, 1.0, 0.0), ("x", 1, None, 0.0)]
    df = spark.createDataFrame(rows, "name string, iteration long, value double, time double").repartition(3)
    events.write_scalars(df, str(tmp_path / "ev"))
    want = sorted((n, i, v, t or 0.0) for n, i, v, t in rows if None not in (n, i, v))
    assert sorted(map(tuple, events.read_scalars(spark, str(tmp_path / "ev")).collect())) == want
    for f in (tmp_path / "ev").glob("*.tfevents"):
        with open(f, "rb") as raw:
            first = raw.read()[12 : 12 + 9 + 2 + len(events.VERSION)]
        assert bytes(wire.message(first)[3][0]).decode() == events.VERSION
    events.write_scalars(df.drop("time").where("name = 'loss'"), str(tmp_path / "ev"))
    assert events.read_scalars(spark, str(tmp_path / "ev")).count() == len(want) + 50


def test_checksums_of_short_records_take_no_lanes(monkeypatch):
    """Frames have a few kB, for which a thousand array steps cost ten times the bytes; both ways give the same sum."""
    import random

    data = random.Random(1).randbytes(70_000)
    short = [tfrecord.crc32c(data[:n]) for n in (0, 1, 1024, 4775, 65_535)]
    monkeypatch.setattr(tfrecord, "_LEAST_LANES", 1)
    assert short == [tfrecord.crc32c(data[:n]) for n in (0, 1, 1024, 4775, 65_535)]
    monkeypatch.undo()
    both = tfrecord.crc32c(data)
    monkeypatch.setattr(tfrecord, "_LEAST_LANES", 1000)
    assert tfrecord.crc32c(data) == both
    monkeypatch.undo()
    monkeypatch.setattr(tfrecord, "np", None)
    assert tfrecord.crc32c(data[:4775]) == short[3]
