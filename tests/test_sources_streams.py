import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources import biff, files, mat5, sinks
from tidemark.streaming import replay


def mat_bytes(arrays, compress=True):
    out = b"x".ljust(124) + struct.pack("<H", 0x0100) + b"IM"

    def el(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    for name, a in arrays.items():
        body = el(6, struct.pack("<II", 6, 0)) + el(5, struct.pack("<ii", *a.shape)) + (struct.pack("<HH", 1, len(name)) + name.encode().ljust(4, b"\0") if len(name) <= 4 else el(1, name.encode())) + el(9, a.astype("<f8").tobytes(order="F"))
        m = struct.pack("<II", 14, len(body)) + body
        if compress:
            z = zlib.compress(m)
            m = struct.pack("<II", 15, len(z)) + z
        out += m
    return out


@pytest.mark.parametrize("compress", [True, False])
def test_mat5(spark, tmp_path, compress):
    a = np.arange(6.0).reshape(2, 3)
    (tmp_path / "x.mat").write_bytes(mat_bytes({"C": a, "aging_time": np.array([[0.5], [1.5]])}, compress))
    spark.dataSource.register(mat5.Mat5DataSource)
    df = spark.read.format("mat5").load(str(tmp_path))
    got = {(r["variable"], r["row_idx"], r["col_idx"]): r["value"] for r in df.collect()}
    assert got == {("C", i, j): a[i, j] for i in range(2) for j in range(3)} | {("aging_time", 0, 0): 0.5, ("aging_time", 1, 0): 1.5}
    with pytest.raises(ValueError):
        list(mat5.variables(mat_bytes({"C": a}, False)[:-9]))


def test_biff_frames_and_guard(spark, tmp_path):
    frame = lambda rid, body=b"": struct.pack("<HH", rid, len(body)) + body
    data = frame(biff.BOF, b"12") + frame(0x203, b"x" * 14) + frame(0x203, b"") + frame(biff.EOF)
    assert [f[0] for f in biff.frames(data + b"\0" * 10)] == [biff.BOF, 0x203, 0x203, biff.EOF]
    assert biff.guard(data, {biff.BOF, biff.EOF, 0x203}) == 4
    for bad, allowed in ((data, {biff.BOF, biff.EOF}), (data[:-4], {biff.BOF, biff.EOF, 0x203}), (data + b"\1", {biff.BOF, biff.EOF, 0x203})):
        with pytest.raises(ValueError):
            biff.guard(bad, allowed)
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(data[:-1])
    got = {(r["path"][-5:], r["record_id"]): (r["n"], r["first_offset"]) for r in biff.profile(spark.read.format("binaryFile").load(str(tmp_path)), ole=False).collect()}
    assert got["a.bin", 0x203] == (2, 6) and ("b.bin", None) in got


def ole_file(name, body):
    """A compound file with one FAT sector, one directory sector and one stream in large sectors."""
    n = -(-len(body) // 512)
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, n + 2), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    head = biff.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<8I", 1, 1, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)

    def entry(name, kind, start, size):
        e = name.encode("utf-16-le") + b"\0\0"
        return e.ljust(64, b"\0") + struct.pack("<HBB", len(e), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, size)

    folder = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, 2, len(body))
    return head + struct.pack("<128I", *fat) + folder.ljust(512, b"\0") + body.ljust(512 * n, b"\0")


def test_ole_stream():
    body = bytes(range(256)) * 10
    assert biff.workbook(ole_file("Workbook", body)) == body
    with pytest.raises(ValueError):
        biff.workbook(ole_file("Other", body))
    with pytest.raises(ValueError):
        biff.workbook(b"no")


def test_strict_json(spark):
    texts = ['{"a":1,"b":[2]}', '{"a":1,"a":2}', '{"b":1,"a":2}', '{"a":NaN}', "{", None, '{"a": 1}']
    df = files.json_problems(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    assert [r["i"] for r in df.orderBy("i").collect() if r["json_error"] is None] == [0]
    loose = files.json_problems(df.drop("json_error"), "t", canonical=False)
    assert [r["i"] for r in loose.orderBy("i").collect() if r["json_error"] is None] == [0, 2, 6]


def test_listings_and_fragments(spark, tmp_path):
    (tmp_path / "l.txt").write_text("Path = a.7z\nType = 7z\n\n----------\nPath = x/y.xls\nSize = 10\n\nPath = x/z.xls\nSize = 20\n")
    got = files.archive_listing(spark, str(tmp_path / "l.txt")).select("member", F.col("props")["Size"]).collect()
    assert sorted(map(tuple, got)) == [("x/y.xls", "10"), ("x/z.xls", "20")]
    (tmp_path / "r.txt").write_text("Archive: a.rar\n\n        Name: x.bin\n        Size: 12\n\n        Name: y.bin\n        Size: 7\n")
    assert sorted((r["member"], r["size"]) for r in files.rar_listing(spark, str(tmp_path / "r.txt")).collect()) == [("x.bin", 12), ("y.bin", 7)]
    p = spark.createDataFrame([("b1/7_0.xls",), ("b1/7_1.xls",), ("b1/8_1.xls",), ("b2/9.xls",), ("junk",)], "path string")
    assert sorted(map(tuple, files.fragment_groups(p).collect())) == [("b1", 7, 2, True), ("b1", 8, 1, False), ("b2", 9, 1, True)]


def test_headers(spark):
    t = spark.createDataFrame([(1, "Start: 3/4/2025 1:02:03\nChannel: 7\n"), (2, "Start: 3/4/2025 1:02:03\nStart: 3/5/2025 1:02:03"), (3, "nothing")], "i int, h string")
    got = {r["i"]: (r["start_status"], str(r["started_at"]), r["channel"]) for r in files.headers(t, "h").collect()}
    assert got == {1: ("OK", "2025-03-04 01:02:03", "7"), 2: ("CONFLICTING_START", "None", None), 3: ("NO_START", "None", None)}


def test_ledger_csv_round_trip_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, "x"), (2, float("inf"), None), (3, None, "y")], "i int, v double, s string")
    sinks.exact_csv(df, str(tmp_path / "c"))
    back = files.read_ledger(spark, str(tmp_path / "c"), "i int, v double, s string")
    assert sorted(map(tuple, back.collect())) == [(1, 0.1, "x"), (2, float("inf"), None), (3, None, "y")]
    with pytest.raises(Exception, match="exist"):
        sinks.exact_csv(df, str(tmp_path / "c"))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    m = spark.createDataFrame([("a.bin", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("b.bin", 1, "x")], "name string, size long, sha256 string")
    assert dict(map(tuple, files.bound_files(spark.read.format("binaryFile").load(str(tmp_path / "f")), m).collect())) == {"a.bin": "OK", "b.bin": "MISSING"}


def test_sealed_and_published(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, i int")
    sinks.sealed_ledger(df, "g", ["i"], str(tmp_path / "led"))
    assert spark.read.parquet(str(tmp_path / "led/seals")).count() == 2
    sinks.publish({"t": df}, str(tmp_path / "out"), {"rows": 3})
    done = json.loads((tmp_path / "out/COMPLETE.json").read_text())
    assert done["rows"] == 3 and spark.read.parquet(str(tmp_path / "out/t")).count() == 3
    with pytest.raises(FileExistsError):
        sinks.write_json(str(tmp_path / "out/COMPLETE.json"), {})
    with pytest.raises(ZeroDivisionError):
        sinks.publish({"t": Bad()}, str(tmp_path / "no"), {})
    assert "ZeroDivisionError" in (tmp_path / "no.staging/BLOCKED.json").read_text()


class Bad:
    @property
    def write(self):
        return 1 / 0


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_stream_equals_batch(spark, tmp_path):
    data = [(u, i, f"2025-01-01 00:{i:02d}:00", float(u * i * i)) for u in (1, 2) for i in range(12)]
    df = spark.createDataFrame(data, "unit long, event_index long, at string, value double").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {(r["unit"], r["origin"]): r["point"] for r in run(spark, replay.forecasts(stream), "f1")}
    want = {(r["unit"], r["origin"]): r["point"] for r in replay.batch_forecasts(df).collect()}
    assert got == pytest.approx(want)


@pytest.fixture()
def small_frames(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_unit_in_many_frames_is_put_in_order(spark, tmp_path, small_frames):
    df = spark.createDataFrame([(u, i, float(i * i % 17)) for u in (1, 2) for i in range(9000 if u == 1 else 5)], "unit long, event_index long, value double").withColumn("at", F.timestamp_seconds(F.col("event_index") * 60))
    df.orderBy(F.desc("event_index")).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {(r["unit"], r["origin"]): r["point"] for r in run(spark, replay.forecasts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "f2")}
    assert got == pytest.approx({(r["unit"], r["origin"]): r["point"] for r in replay.batch_forecasts(df).collect()})
    r = df.select(F.col("unit").alias("grp"), F.col("event_index").alias("seq"), F.col("event_index").alias("record_number"))
    r.orderBy(F.desc("seq")).coalesce(1).write.parquet(str(tmp_path / "r"))
    got = run(spark, replay.running_counters(spark.readStream.schema(r.schema).parquet(str(tmp_path / "r"))), "c2", "update")
    assert sorted(map(tuple, got)) == [(1, 9000, 0, 0, 0), (2, 5, 0, 0, 0)]


@pytest.mark.parametrize("held", [1, 10, 1000])
def test_rows_of_many_frames_in_order(held):
    r = np.random.default_rng(0)
    frames = [pd.DataFrame({"i": r.integers(0, 50, n), "k": k}) for k, n in enumerate((9, 0, 30, 1, 25))]
    got = [tuple(x) for x in replay.in_order(iter(frames), "i", held, 4)]
    assert got == sorted((tuple(x) for f in frames for x in f.itertuples(index=False)), key=lambda x: x[0])
    assert list(replay.in_order(iter([]), "i")) == []


def test_labels_mature_or_never(spark, tmp_path):
    df = spark.createDataFrame([(1, i, f"2025-01-{i + 1:02d} 00:00:00", float(i)) for i in range(28)], "unit long, event_index long, at string, value double").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    p = df.select("unit", F.col("event_index").alias("origin"), (F.col("event_index") + F.when(F.col("event_index") == 2, 500).otherwise(1)).alias("target_index"), F.col("at").alias("made_at"), F.col("value").alias("point"))
    p.write.parquet(str(tmp_path / "p"))
    j = replay.matured(spark.readStream.schema(p.schema).parquet(str(tmp_path / "p")), spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "2 days")
    got = {r["origin"]: (r["status"], r["actual"]) for r in run(spark, j, "m1")}
    assert got[0] == ("MATURED", 1.0) and got[2] == ("NEVER_MATURED", None)


def test_commit_and_counters(spark, tmp_path):
    r = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 2, 2, 5, 4])], "grp long, seq long, record_number long")
    r.write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(r.schema).parquet(str(tmp_path / "r"))
    got = run(spark, replay.running_counters(stream), "c1", "update")[-1]
    assert tuple(got) == (1, 5, 1, 1, 1)
    q = replay.commit_batches(spark.readStream.schema(r.schema).parquet(str(tmp_path / "r")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
