"""Readers, writers, stores and streams."""

import datetime as dt
import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from framewright import schemas
from framewright.operators import sessions
from framewright.sources import files, manifests
from framewright.sources.tables import Store
from framewright.streaming import sessions as streaming


def test_scan_and_sidecars(spark, tmp_path):
    for n in ("A.ORF", "A.JPG", "B.SRW", "b.jpg", "C.JPG", "notes.txt"):
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "D.JPG").write_bytes(b"x")
    got = {r["name"] for r in files.without_sidecars(files.scan(spark, str(tmp_path))).collect()}
    assert got == {"A.ORF", "B.SRW", "C.JPG"}
    have = files.scan(spark, str(tmp_path), content=True)
    md5 = hashlib.md5(b"C.JPG").hexdigest()
    catalog = spark.createDataFrame([("C.JPG", "u", md5, 5), ("A.ORF", "u", "stale", 5), ("Z.ORF", "u", "none", 5)], schemas.CATALOG)
    assert {r["name"] for r in files.worklist(catalog, have).collect()} == {"A.ORF", "Z.ORF"}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "1.zip", "w") as z:
        z.writestr("1/a.jpg", b"aa")
        z.writestr("1/b.jpg", b"b")
    (tmp_path / "2.zip").write_bytes(b"broken")
    got = files.archive_members(spark, str(tmp_path / "*.zip")).collect()
    assert {r["member"]: r["content"] and bytes(r["content"]) for r in got} == {"1/a.jpg": b"aa", "1/b.jpg": b"b", None: None}
    assert [r["error"] is not None for r in got if r["member"] is None] == [True]


def test_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("7", "i", "m", None, 0, "train"), ("8", "i", "m", 22, 1, "test")], schemas.MANIFEST + ", split string")
    manifests.write_manifest(rows, str(tmp_path / "m"))
    back = {r["camera"]: (r["hour"], r["night"]) for r in manifests.read_manifest(spark, str(tmp_path / "m" / "split=*")).collect()}
    assert back == {"7": (None, 0), "8": (22, 1)}
    doc = manifests.splits_document(spark.createDataFrame([("10", "train"), ("9", "train"), ("3", "test"), ("4", "val")], "camera string, split string"), 0)
    assert doc.first()["train"] == ["9", "10"]
    manifests.write_report(doc, str(tmp_path / "s"))
    assert {(r["split"], r["camera"]) for r in manifests.read_splits(spark, str(tmp_path / "s")).collect()} == {("train", "9"), ("train", "10"), ("test", "3"), ("val", "4")}
    log = spark.createDataFrame([(1, 0.5, (0.4, 0.7, 0.6, 0.8, 10), 1.0, 0.7, 20)], schemas.TRAINING_LOG)
    for _ in range(2):
        manifests.append_log(log, str(tmp_path / "log"))
    assert [r["val"]["miou"] for r in manifests.read_training_log(spark, str(tmp_path / "log")).collect()] == [0.7, 0.7]
    (tmp_path / "meta.csv").write_text("CamId,fog,Fog\n1,0.5,1\n")
    r = manifests.read_metadata(spark, str(tmp_path / "meta.csv"), ["cam", "fog_score", "fog_flag"]).first()
    assert (r["fog_score"], r["fog_flag"]) == ("0.5", "1")
    assert manifests.best_effort(manifests.append_log, log, "/proc/none/x") is not None


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    new = spark.createDataFrame([('["a"]', "o", "{}"), ('["b"]', "o", "{}"), ('["b"]', "o", "{}")], "bracket_files string, output_path string, settings string")
    assert s.enqueue(new, "t0") == {"added": 2, "skipped": 1}
    assert s.enqueue(new, "t1") == {"added": 0, "skipped": 3}
    s.set_status(1, "running", "t2")
    s.set_status(2, "failed", "t2")
    assert {r["job_id"]: r["status"] for r in s.states().collect()} == {1: "running", 2: "failed"}
    s.recover("t3")
    s.retry("t4")
    assert {r["status"] for r in s.states().collect()} == {"pending"}
    with pytest.raises(ValueError):
        s.set_status(1, "done", "t5")
    s.append("adjustments", spark.createDataFrame([(1, "a", "p", 1.0, 2.0, 1.0, "t"), (2, "b", "p", 1.0, 2.0, 1.0, "t")], schemas.ADJUSTMENTS))
    assert s.forget("scene_type", "a") == 1 and s.read("adjustments", schemas.ADJUSTMENTS).count() == 1
    assert s.forget() == 1 and s.read("adjustments", schemas.ADJUSTMENTS).count() == 0
    old = spark.createDataFrame([(1,)], "job_id long")
    assert schemas.migrated(old, schemas.JOBS).first()["error"] is None
    assert schemas.violations(spark.createDataFrame([("x",), ("whole",)], "mode string"), "mode", schemas.MODES).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    start, rows, t = dt.datetime(2024, 1, 1), [], 0
    for i in range(60):
        t += [1, 5, 20, 12, 40, 3][i % 6]
        rows.append((i % 2, i, start + dt.timedelta(seconds=t), 0.5))
    rows.append((9, 999, start + dt.timedelta(days=3), 0.0))
    schema = "user_id long, event_id long, ts timestamp, value double"
    src = tmp_path / "in"
    for a in range(0, len(rows), 20):
        spark.createDataFrame(rows[a : a + 20], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = streaming.bracket_stream(stream, "1 minute").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["user_id"], r["n"], r["first_event"], r["last_event"]) for r in spark.table("closed").collect()}
    batch = sessions.assign_sessions(spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["user_id"], "ts", "event_id", "value")
    kept, _ = sessions.brackets(batch, ["user_id"], "ts", "event_id")
    want = {(r["user_id"], r["n"], r["members"][0], r["members"][-1]) for r in kept.collect()}
    assert got == want and want


def test_replacement_that_stops_leaves_a_whole_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "v int")
    read = lambda: sorted(r["v"] for r in store.read("t", "v int").collect())
    store.replace("t", rows(1, 2))
    store.replace("t", store.read("t", "v int").filter("v > 1"))
    assert read() == [2]
    move = store._move
    for stop in (0, 1):
        left = [stop]

        def breaking(a, b):
            if not left[0]:
                raise OSError("stopped")
            left[0] -= 1
            move(a, b)

        store._move = breaking
        with pytest.raises(OSError):
            store.replace("t", rows(7))
        store._move = move
        assert read() == [2]
    store.replace("t", rows(7, 8))
    assert read() == [7, 8]
