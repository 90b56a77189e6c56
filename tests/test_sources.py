from __future__ import annotations

import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import sources
from pointloom.operators import spatial
from pointloom.plans import spec
from pointloom.sources import binary, npy, ply, sinks, zips
from pointloom.streaming import metrics as streams


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    sources.register(spark)


def points(spark):
    rows = [("train", f"s{s}", i, float(i), float(s), 0.5, 10.0 * i, 20.0, 30.0, i % 3) for s in range(2) for i in range(5)]
    return spark.createDataFrame(rows, "split string, scene string, point_idx long, x double, y double, z double, r double, g double, b double, segment long")


def test_npy_round_trip(spark, tmp_path):
    df = points(spark)
    assert npy.write_scenes(df, str(tmp_path)) == 2
    back = npy.scenes(spark, str(tmp_path), "train")
    assert back.count() == 10
    assert back.select(*df.columns).exceptAll(df).count() == 0
    assert back.where("instance <> -1 or nx is not null").count() == 0
    some = npy.scenes(spark, str(tmp_path), "train", names=spark.createDataFrame([("s1",)], "scene string"), columns=["segment"])
    assert some.columns == ["split", "scene", "point_idx", "segment"] or set(some.columns) == {"split", "scene", "point_idx", "segment"}
    assert some.count() == 5
    hidden = npy.with_labeled_index(back, back.where("point_idx = 1"))
    assert hidden.where("segment >= 0").count() == 2


def test_bad_npy(spark, tmp_path):
    (tmp_path / "train" / "s").mkdir(parents=True)
    (tmp_path / "train" / "s" / "coord.npy").write_bytes(b"no array")
    read = spark.read.format("npy_scene").option("path", str(tmp_path / "train"))
    assert read.option("skip_bad", "true").load().count() == 0
    with pytest.raises(Exception):
        read.option("skip_bad", "false").load().count()


def test_ply_forms(spark, tmp_path):
    head = "ply\nformat {} 1.0\ncomment c\nelement vertex 2\nproperty float x\nproperty double y\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii") + "1.5 2 7\n3 4 255\n3 0 1 1\n")
    for name, o in (("b", "<"), ("c", ">")):
        body = struct.pack(o + "fdB", 1.5, 2, 7) + struct.pack(o + "fdB", 3, 4, 255) + struct.pack(o + "B3i", 3, 0, 1, 1)
        (tmp_path / f"{name}.ply").write_bytes(head.format("binary_little_endian" if o == "<" else "binary_big_endian").encode() + body)
    v = spark.read.format("ply").option("path", str(tmp_path)).load()
    got = sorted(tuple(r) for r in v.select("scene", "idx", "x", "y", "red").collect())
    assert got == [(s, *r) for s in "abc" for r in ((0, 1.5, 2.0, 7), (1, 3.0, 4.0, 255))]
    f = spark.read.format("ply").option("path", str(tmp_path)).option("element", "face").load()
    assert [r.vertex_indices for r in f.collect()] == [[0, 1, 1]] * 3


def test_ply_writer(spark, tmp_path):
    df = points(spark)
    assert ply.write_ply(df, str(tmp_path)) == 2
    back = spark.read.format("ply").option("path", str(tmp_path)).load()
    assert {(r.scene, r.idx, r.x, r.red) for r in back.collect()} == {(r.scene, r.point_idx, r.x, int(r.r)) for r in df.collect()}


def test_fixed_binary(spark, tmp_path):
    a = np.arange(15, dtype="<f4").reshape(3, 5)
    (tmp_path / "f.bin").write_bytes(a.tobytes() + b"xx")
    d = spark.read.format("fixed_binary").option("path", str(tmp_path)).load()
    assert [(r.x, r.ring) for r in d.orderBy("point_idx").collect()] == [(0.0, 4.0), (5.0, 9.0), (10.0, 14.0)]
    labels = spark.createDataFrame([("f", 0, 3), ("f", 1, 9)], "frame string, point_idx long, label int")
    p = binary.lidar_points(d.withColumn("frame", F.lit("f")), labels, {3: 1}).orderBy("point_idx").collect()
    assert [(r.segment, r.strength) for r in p] == [(1, 3 / 255), (-1, 8 / 255), (-1, 13 / 255)]


def test_label_files(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 4), ("s", 0, 2)], "scene string, point_idx long, pred long")
    assert binary.write_labels(df, str(tmp_path), inverse={2: 20, 4: 40}) == 1
    assert np.fromfile(tmp_path / "s.label", "<u4").tolist() == [20, 40]


def test_sens(spark, tmp_path):
    m = struct.pack("<16f", *range(16))
    data = struct.pack("<IQ", 4, 3) + b"cam" + m * 4 + struct.pack("<iiIIIIfQ", 2, 1, 4, 3, 2, 1, 1000.0, 3)
    for i in range(3):
        data += m + struct.pack("<QQQQ", i, i + 10, 2, 1) + b"cc" + bytes([i])
    (tmp_path / "x.sens").write_bytes(data)
    r = spark.read.format("sens").option("path", str(tmp_path)).option("every", "2").load().orderBy("frame_no").collect()
    assert [(x.frame_no, x.timestamp_depth, bytes(x.depth)) for x in r] == [(0, 10, b"\0"), (2, 12, b"\2")]


def test_zip_members(spark, tmp_path):
    for n in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr(f"root/{n}/one.txt", n)
            z.writestr("root/two.txt", "2")
    m = spark.read.format("zip_members").option("path", str(tmp_path)).load()
    assert m.count() == 4 and {bytes(r.content) for r in m.where("name like '%one%'").collect()} == {b"a", b"b"}
    assert {r.child for r in zips.children(m, "root").collect()} == {"a", "b", "two.txt"}


def test_sinks(spark, tmp_path):
    df = points(spark)
    sinks.write_points(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 10
    for _ in range(2):
        sinks.append_missing(df, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 10
    pred = df.select("scene", "point_idx", F.col("segment").alias("pred"))
    sinks.submission_text(pred, str(tmp_path / "t"), {0: 10, 1: 11, 2: 12})
    lines = "".join(p.read_text() for p in sorted((tmp_path / "t" / "scene=s0").glob("part*")))
    assert lines.split() == ["10", "11", "12", "10", "11"]
    (tmp_path / "m.json").write_text('["a/b", "c"]')
    assert [r.path for r in sinks.manifest(spark, str(tmp_path / "m.json")).collect()] == ["a/b", "c"]
    (tmp_path / "l.txt").write_text("s1\n\n s1 \n")
    assert [r.scene for r in sinks.name_list(spark, str(tmp_path / "l.txt")).collect()] == ["s1"]


def test_specs(spark):
    with pytest.raises(KeyError):
        spec.compose([{"type": "no_such"}])
    base = {"a": {"b": 1, "c": [1, 2]}, "d": 3}
    assert spec.inherit({"_base_": "x", "a": {"b": 2}}, lambda _: base) == {"a": {"b": 2, "c": [1, 2]}, "d": 3}
    assert spec.inherit({"_base_": "x", "a": {"_delete_": True, "z": 1}}, lambda _: base)["a"] == {"z": 1}
    with pytest.raises(KeyError):
        spec.inherit({"_base_": ["x", "y"]}, lambda _: base)
    assert spec.overridden(base, {"a.c.1": 9, "e.f": 1}) == {"a": {"b": 1, "c": [1, 9]}, "d": 3, "e": {"f": 1}}
    assert (spec.value_of("1,2"), spec.value_of("x"), spec.value_of("(1,a)"), spec.value_of("true")) == ([1, 2], "x", (1, "a"), True)
    with pytest.raises(KeyError):
        spec.OPERATORS.register("rotate", lambda d: d)
    df = points(spark)
    frags = spec.test_time(df.withColumn("scene", F.lit(0).cast("long")), [[], [{"type": "update", "z": 0.0}]], 2.0)
    assert frags.select("aug").distinct().count() == 2


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, ("a", "b")[i % 2], float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.to_tables(streams.running_means(stream), str(tmp_path / "out"), str(tmp_path / "ck"), "complete")
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.exceptAll(streams.running_means(df)).count() == 0 and got.count() == 2
    w = streams.windowed(stream, "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("w").exceptAll(streams.windowed(df, "10 minutes")).count() == 0


def test_infos_round_trip(spark, tmp_path):
    schema = "split string, lidar_token string, lidar_path string, sweeps array<struct<path: string, time_lag: double>>, gt map<string, int>"
    rows = [("train", "a", "l/a.bin", [("l/s.bin", 0.05)], {"car": 2}), ("train", "b", "l/b.bin", [], None), ("val", "c", None, None, {})]
    df = spark.createDataFrame(rows, schema)
    sinks.write_infos(df, str(tmp_path))
    back = sinks.infos(spark, str(tmp_path), ["train", "val"])
    key = lambda d: sorted(repr(r.asDict(True)) for r in d.select(df.columns).collect())
    assert key(back) == key(df)
    assert [r.lidar_token for r in sinks.infos(spark, str(tmp_path), "val").collect()] == ["c"]
    assert sinks.infos(spark, str(tmp_path), ["val", "val"]).count() == 2
    assert sinks.infos(spark, str(tmp_path), "test").count() == 0
    sinks.write_infos(df.where("split = 'val'").withColumn("lidar_token", F.lit("d")), str(tmp_path))
    assert sorted(r.lidar_token for r in sinks.infos(spark, str(tmp_path), ["train", "val"]).collect()) == ["a", "b", "d"]
    with pytest.raises(ValueError):
        sinks.infos(spark, str(tmp_path), [])


def test_overlapping_takes_the_bound(spark):
    pairs = spark.createDataFrame([("a", "b", 0.3), ("a", "c", 0.29), ("b", "c", 0.5), ("c", "d", None)], "a string, b string, ratio double")
    assert sorted((r.a, r.b) for r in spatial.overlapping(pairs).collect()) == [("a", "b"), ("b", "c")]


def test_names_and_loops(spark, tmp_path):
    at = tmp_path / "set" / "train" / "scene1"
    spark.range(3).write.parquet(f"{at}/a.parquet")
    spark.range(2).write.parquet(f"{tmp_path}/set/val/scene2/a.parquet")
    read = spark.read.parquet(*(str(p) for p in sorted(tmp_path.glob("set/*/*/*.parquet/part-*"))))
    folders = sinks.named_by_path(read).select("split", "scene").distinct().collect()
    assert {tuple(r) for r in folders} == {("scene1", "a.parquet"), ("scene2", "a.parquet")}  # the last two folders
    looped = npy.repeated(spark.range(4), 3)
    assert looped.count() == 12 and {r.loop_no for r in looped.collect()} == {0, 1, 2}
    both = npy.concatenated(spark.range(2).withColumn("x", F.lit(1)), spark.range(3).withColumn("y", F.lit("b")))
    assert sorted((r.dataset, r.id, r.x, r.y) for r in both.collect() if r.dataset == 0) == [(0, 0, 1, None), (0, 1, 1, None)] and both.where("dataset = 1 and x is null and y = 'b'").count() == 3


def test_text_outputs_read_back(spark, tmp_path):
    (tmp_path / "map.tsv").write_text("id\tname\n1\twall\n7\tfloor\n")
    assert [tuple(r) for r in sinks.label_map(spark, str(tmp_path / "map.tsv"), "id int, name string").orderBy("id").collect()] == [(1, "wall"), (7, "floor")]
    top = spark.createDataFrame([("s1", i, f"{i} {i + 1} {i + 2}") for i in range(30)] + [("s2", 0, "9 8 7")], "scene string, point_idx long, classes string").repartition(4)
    sinks.top_classes_text(top, str(tmp_path / "top"))
    (one,) = (tmp_path / "top" / "scene=s1").glob("*.txt")
    assert one.read_text().split("\n")[:-1] == [f"{i} {i + 1} {i + 2}" for i in range(30)]
    sinks.overlap_text(spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.25)], "a string, b string, ratio double"), str(tmp_path / "pairs"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "pairs")).collect()) == ["a b 0.5", "a c 0.25"]
    sinks.json_metrics(spark.createDataFrame([(1, "loss", 2.0), (1, "acc", 0.5), (2, "loss", 1.0)], "iteration long, name string, value double"), str(tmp_path / "json"))
    got = spark.read.json(str(tmp_path / "json")).orderBy("iteration").collect()
    assert [(r.iteration, r.loss, r.acc) for r in got] == [(1.0, 2.0, 0.5), (2.0, 1.0, None)]


def test_an_interrupted_evaluation_goes_on(spark, tmp_path):
    """A run that breaks off in the middle and is called again gives what an undisturbed one gives, without doing a scene twice."""
    from pointloom.sources import resume

    rows = [(s, i, (s + i) % 4, (s * i) % 4) for s in range(24) for i in range(5 + s)]
    df = spark.createDataFrame(rows, "scene long, point_idx long, target long, pred long")
    asked: list[set] = []

    def confusion(part, broken=()):
        asked.append({r.scene for r in part.select("scene").distinct().collect()})
        stop = F.when(F.col("scene").isin(*broken), F.raise_error(F.lit("interrupted")).cast("long")).otherwise(F.col("pred")) if broken else F.col("pred")
        return part.withColumn("pred", stop).groupBy("scene", "target", "pred").count()

    whole = resume.resumed(df, str(tmp_path / "whole"), confusion)
    asked.clear()
    with pytest.raises(Exception, match="interrupted"):
        resume.resumed(df, str(tmp_path / "broken"), lambda p: confusion(p, (5, 11)))
    finished = {r.scene for r in (resume.results(spark, str(tmp_path / "broken")) or df.where("false")).select("scene").distinct().collect()}
    assert 0 < len(asked) < 8 and finished == set().union(*asked[:-1])
    asked.clear()
    again = resume.resumed(df, str(tmp_path / "broken"), confusion)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))
    assert set().union(*asked) == set(range(24)) - finished
    asked.clear()
    more = df.unionByName(spark.createDataFrame([(99, 0, 1, 1), (None, 0, 1, 1)], df.schema))
    assert resume.resumed(more, str(tmp_path / "broken"), confusion).count() == whole.count() + 1 and asked == [{99}]
    assert resume.resumed(df.where("false"), str(tmp_path / "none"), confusion).count() == 0
