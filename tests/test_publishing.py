"""Versions and logs that a failure leaves whole, runs by their files, the dataset source, and streams against tables."""

import json
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.operators import metrics
from quern.sources import publish, runs
from quern.sources.dataset import ManifestSource, shards
from quern.streaming import speech
from quern.streaming.deltas import delta_stream


def visible(folder):
    return sorted(n for n in os.listdir(folder) if not n.startswith(".")) if os.path.isdir(folder) else []


def test_a_failed_version_leaves_nothing(spark, tmp_path):
    target = str(tmp_path / "out")
    good, more = spark.range(10).withColumn("mode", F.col("id") % 2), spark.range(5)
    first = publish.publish(spark, target, {"rows": good, "sums": more}, split={"rows": ["mode"]})
    before = visible(target)
    assert before == sorted(["CURRENT", os.path.basename(first)]) and publish.current_version(spark, target)["rows"] == {"rows": 10, "sums": 5}
    broken = spark.range(20).withColumn("x", F.when(F.col("id") == 13, F.raise_error(F.lit("lost"))).otherwise(1))
    with pytest.raises(PySparkException):
        publish.publish(spark, target, {"rows": good, "sums": broken})
    with pytest.raises(ValueError, match="not these"):
        publish.publish(spark, target, {"rows": more}, lambda back: "not these")
    assert visible(target) == before
    assert sorted(tuple(r) for r in publish.published(spark, target, "rows", "id long, mode long").collect()) == [(k, k % 2) for k in range(10)]
    publish.publish(spark, target, {"rows": more})
    assert publish.published(spark, target, "rows", "id long").count() == 5
    with pytest.raises(FileNotFoundError):
        publish.published(spark, str(tmp_path / "none"), "rows")


def test_splits_are_exported_together(spark, tmp_path):
    target = str(tmp_path / "splits")
    plan = spark.createDataFrame([(str(k), f"a{k}.wav", f"text {k}", "train" if k % 3 else "test") for k in range(30)], "id string, audio string, text string, split string")
    with pytest.raises(ValueError, match="verified"):
        publish.export_splits(plan, plan.where("id <> '7'"), target)
    assert visible(target) == []
    folder = publish.export_splits(plan, plan, target)
    assert sorted(visible(f"{folder}/manifests")) == ["_SUCCESS", "split=test", "split=train"]
    back = publish.published(spark, target, "manifests", "audio string, text string, split string")
    assert sorted(tuple(r) for r in back.select("split", "audio", "text").collect()) == sorted(tuple(r) for r in plan.select("split", "audio", "text").collect())


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).select("id", (F.col("id") % 7).alias("key")).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema("id long, key long").option("maxFilesPerTrigger", 1).json(source)
    crashed = []

    def fails_after_writing(batch, number):
        publish.append_once(batch, log, number)
        if number == 1 and not crashed:
            crashed.append(number)
            raise RuntimeError("the machine went away")

    query = stream.writeStream.foreachBatch(fails_after_writing).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(PySparkException):
        query.awaitTermination()
    files = {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(log) for n in names}
    publish.append_stream(stream, log, checkpoint).awaitTermination()
    again = {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(log) for n in names}
    assert crashed and visible(log) == ["batch=0", "batch=1", "batch=2"] and all(again[f] == at for f, at in files.items())
    assert not publish.append_once(spark.range(3), log, 2)
    rows = publish.log_rows(spark, log, "id long, key long")
    assert sorted(r.id for r in rows.collect()) == list(range(30))
    assert {r.key: r.id for r in publish.snapshot(rows, "key", ["id"]).collect()} == {k: max(x for x in range(30) if x % 7 == k) for k in range(7)}


def test_the_newest_complete_run(spark, tmp_path):
    """10,000 folders of which few are complete; the newest by its files, not by its name."""
    base = tmp_path / "results"
    for k in range(10_000):
        folder = base / f"run_{k:05d}"
        folder.mkdir(parents=True)
        (folder / "run.json").write_text("{}")
        if k % 2000 == 77:
            (folder / "phrase_1.wav").write_bytes(b"x" * k)
            os.utime(folder / "phrase_1.wav", (2_000_000_000 - k, 2_000_000_000 - k))
    barred = base / "sweep_1"
    barred.mkdir()
    for name in ("run.json", "phrase_9.wav"):
        (barred / name).write_bytes(b"later")
        os.utime(barred / name, (2_100_000_000, 2_100_000_000))
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", "16")
    files = runs.files_under(spark, str(base)).cache()
    needed = ["phrase_*.wav", "run.json"]
    assert runs.newest(runs.complete_runs(files, needed, F.startswith("run", F.lit("sweep")))).first().run == "run_00077"
    assert runs.newest(runs.complete_runs(files, needed), "run").first().run == "sweep_1"
    got = runs.newest_files(files, needed, barred=F.startswith("run", F.lit("sweep"))).collect()
    assert sorted((r.name, r["size"]) for r in got) == [("phrase_1.wav", 77), ("run.json", 2)]
    assert runs.newest(runs.complete_runs(files, ["absent.txt"])).count() == 0


def test_the_dataset_source(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "audio").mkdir()
    rows = []
    for k in range(60):
        (tmp_path / "audio" / f"{k}.wav").write_bytes(rng.randbytes(rng.randrange(0, 5000)))
        rows.append({"audio": f"audio/{k}.wav" if k % 2 else str(tmp_path / "audio" / f"{k}.wav"), "text": "слово " * rng.randrange(1, 40)})
    (tmp_path / "train.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows[:50]) + "\n\n{broken\n" + json.dumps({"audio": "audio/none.wav", "text": "t"}))
    (tmp_path / "test.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows[50:]))
    (tmp_path / "empty.jsonl").write_text("")
    spark.dataSource.register(ManifestSource)
    paths = [str(tmp_path / n) for n in ("train.jsonl", "test.jsonl", "empty.jsonl")]
    for size in (700, 1 << 20):
        got = spark.read.format("audio_manifest").option("manifests", ",".join(paths)).option("shard_bytes", size).load()
        assert got.rdd.getNumPartitions() == sum(len(shards(p, size)) for p in paths)
        found = got.collect()
        fine = {(r.split, r.audio, r.text, bytes(r.content)) for r in found if r.error is None}
        plain = {("train" if k < 50 else "test", r["audio"], r["text"], (tmp_path / "audio" / f"{k}.wav").read_bytes()) for k, r in enumerate(rows)}
        assert fine == plain and len(found) == 62
        assert sorted(r.error for r in found if r.error) == ["audio: FileNotFoundError", "line: JSONDecodeError"]


def test_segments_of_a_long_stream_in_parts(spark, tmp_path):
    """A million blocks of one stream and a short one; a task takes 100,000 at most."""
    rng = np.random.Generator(np.random.PCG64(4))
    limits = speech.Limits()
    loud = np.repeat(rng.integers(0, 2, 50_000), rng.integers(1, 40, 50_000))[:1_000_000]
    level = np.where(loud, 0.05, 0.001) * rng.uniform(0.5, 1.5, len(loud))
    rows = pd.DataFrame({"stream": "long", "block": np.arange(len(level)), "level": level})
    rows = pd.concat([rows, pd.DataFrame({"stream": "short", "block": np.arange(300_000, 300_200), "level": 0.05})])
    state, wanted = speech.FRESH, []
    for block, x in enumerate(level.tolist()):
        state, done = speech.advance(state, block, x, limits)
        wanted += [done] if done else []
    rows.sample(frac=1.0, random_state=1).to_parquet(tmp_path / "blocks.parquet")
    got = speech.segments(spark.read.parquet(str(tmp_path / "blocks.parquet")), limits).collect()
    assert sorted(tuple(r)[1:] for r in got if r.stream == "long") == sorted(wanted) and len(wanted) > 1000
    assert [tuple(r)[1:] for r in got if r.stream == "short"] == []


def test_deltas_of_shuffled_batches(spark, tmp_path):
    """Samples come out of order within the allowed lateness, also across batches; what the watermark has passed is as on a table."""
    rng = random.Random(3)
    start = datetime(2026, 1, 1)
    samples = [(k % 3, start + timedelta(seconds=k // 2), k, float(k * k % 1000)) for k in range(300)]
    late = sorted(samples, key=lambda r: (r[1] + timedelta(seconds=rng.uniform(0, 40)), r[2]))
    flush = [(9, start + timedelta(days=1), 10**6, 0.0)]
    schema = "key long, at timestamp, place long, total double"
    for k in range(6):
        rows = late[50 * k : 50 * k + 50] + (flush if k == 5 else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(max((tmp_path / "in").glob("part-*"), key=os.path.getctime), (1_700_000_000 + k, 1_700_000_000 + k))
    spark.createDataFrame([(9, start + timedelta(days=2), 10**6 + 1, 0.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = delta_stream(stream, "60 seconds").writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    told = sorted(tuple(r) for r in spark.sql("SELECT key, place, rate FROM told WHERE key < 9").collect())
    table = spark.createDataFrame(samples, schema).withColumn("t", F.unix_micros("at") / 1e6)
    wanted = sorted(tuple(r) for r in metrics.deltas(table, "key", ["t", "place"], F.col("t"), "total").select("key", "place", "rate").collect())
    assert [x[:2] for x in told] == [x[:2] for x in wanted]
    assert [x[2] for x in told] == [None if x[2] is None else pytest.approx(x[2]) for x in wanted]
