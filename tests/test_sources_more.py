"""Samples of any format, caches, numbered lines, reviewed names, quotas, rules of a recorded set, and the command line."""

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern import __main__ as command
from quern.functions import numbers
from quern.functions import text as tx
from quern.operators import audit, planning, positions, reports
from quern.sources import readers, writers


def wav(body: bytes, kind=1, channels=1, rate=8000, bits=16) -> bytes:
    head = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 28 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def test_samples_of_any_format():
    assert readers.wav_samples(wav(struct.pack("<2h", 16384, -32768))).tolist() == [0.5, -1.0]
    assert readers.wav_samples(wav(bytes([128, 255, 0]), bits=8)).tolist() == pytest.approx([0, 127 / 128, -1])
    assert readers.wav_samples(wav(b"\0\0\x40\0\0\xc0", bits=24)).tolist() == [0.5, -0.5]
    assert readers.wav_samples(wav(struct.pack("<2f", 0.25, -0.75), 3, bits=32)).tolist() == [0.25, -0.75]
    assert readers.wav_samples(wav(struct.pack("<4h", 16384, 0, 0, -16384), channels=2)).tolist() == [0.25, -0.25]
    with pytest.raises(ValueError, match="compressed"):
        readers.wav_samples(wav(b"ab", 6, bits=8))


def test_resampling_keeps_tones_and_cuts_what_cannot_be_held():
    t = np.arange(48_000) / 48_000
    low, high = readers.resampled(np.sin(2 * np.pi * 1000 * t), 8000, 48_000), readers.resampled(np.sin(2 * np.pi * 6000 * t), 8000, 48_000)
    assert len(low) == 8000 and np.abs(low[200:-200] - np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000)[200:-200]).max() < 0.01
    assert np.abs(high[200:-200]).max() < 0.01
    assert len(readers.resampled(np.ones(441), 8000, 44_100)) == 80


def test_sample_rows_and_caches(spark, tmp_path):
    tone = (0.5 * np.sin(np.arange(8000) / 3) * 32767).astype("<i2").tobytes()
    files = {"good.wav": wav(tone), "short.wav": wav(tone[:200]), "silent.wav": wav(bytes(16_000)), "bad.wav": b"RIFF"}
    writers.write_files(spark.createDataFrame([(f"deep/{n}", bytearray(b)) for n, b in files.items()], "name string, content binary"), str(tmp_path))
    rows = readers.usable(readers.wav_sample_rows(readers.wav_files(spark, str(tmp_path)))).collect()
    got = {r.path.split("/")[-1]: r for r in rows}
    assert {n: r.problem for n, r in got.items()} == {"good.wav": None, "short.wav": "duration", "silent.wav": "silent", "bad.wav": "not a WAV file"}
    assert all(r.file_sha256 == hashlib.sha256(files[n]).hexdigest() for n, r in got.items()) and got["bad.wav"].samples_sha256 is None
    cache = spark.createDataFrame([("a", bytearray(writers.npz_bytes(logprobs=np.arange(6.0).reshape(2, 3)))), ("b", bytearray(writers.npz_bytes(other=np.ones(2))))], "path string, content binary")
    assert sorted(tuple(r) for r in readers.cached_arrays(cache, "logprobs").collect())[0] == ("a", 2, 3, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    assert readers.cached_arrays(cache, "logprobs").where("path = 'b' AND values IS NULL").count() == 1


def test_numbered_json_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "a"}\n\n{"id": \n{"id": "b"}\n')
    good, bad = readers.numbered_json_lines(spark, str(tmp_path / "m.jsonl"), "id string")
    assert sorted((r.line_no, r.id) for r in good.collect()) == [(1, "a"), (4, "b")] and [(r.line_no, r.raw) for r in bad.collect()] == [(3, '{"id": ')]


def test_names_without_review_are_refused(spark):
    name = lambda x: spark.createDataFrame([(x,)], "n string")
    assert name("Лесная улица").select(tx.reviewed_declension(F.col("n")).alias("f")).first().f.pre == "лесной улице"
    assert name("улица 40 лет").select(tx.reviewed(F.col("n")).alias("f")).first().f == "улица сорок лет"
    for bad in ("Площадь Мира", "улица 41 года"):
        with pytest.raises(PySparkException):
            name(bad).select(tx.reviewed_declension(F.col("n"))).collect()
    with pytest.raises(PySparkException):
        name("улица 41 года").select(tx.reviewed(F.col("n"))).collect()


def test_split_sizes_and_quotas(spark):
    assert [tuple(numbers.split_sizes(n).values()) for n in (2, 3, 10, 100, 500)] == [(1, 0, 1), (1, 1, 1), (8, 1, 1), (90, 5, 5), (450, 25, 25)]
    with pytest.raises(ValueError):
        numbers.split_sizes(1)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, x int")
    assert planning.require_quota(rows.where("g = 'a'"), rows.where("g = 'a'"), ["g"], F.lit(2)).count() == 2
    with pytest.raises(ValueError, match="b 1 2"):
        planning.require_quota(rows, rows, ["g"], F.lit(2))


def test_canonical_json(spark):
    record = {"b": 'q"\\ é\n', "a": 7, "c": None}
    got = spark.createDataFrame([tuple(record.values())], "b string, a long, c string").select(numbers.canonical_json(["b", "a", "c"]).alias("j"), numbers.canonical_digest(["b", "a", "c"]).alias("d")).first()
    want = json.dumps(record, ensure_ascii=False, sort_keys=True)
    assert got.j == want and got.d == hashlib.sha256(want.encode()).hexdigest()


GOOD = {"variant": "full", "status": "saved", "reference_raw": "x", "reference": "x", "audio": "audio/a.wav", "street": "s", "duration": 1.0, "rate": 8000, "channels": 1, "planned_street": "s", "planned_variant": "full", "has_plan": True, "there": True, "readable": True, "wav_rate": 8000, "wav_channels": 1, "wav_bytes": 2, "codec": "NONE", "frames": 8000, "file_bytes": 16_044}
RECORD = "variant string, status string, reference_raw string, reference string, audio string, street string, duration double, rate int, channels int, planned_street string, planned_variant string, has_plan boolean, there boolean, readable boolean, wav_rate int, wav_channels int, wav_bytes int, codec string, frames long, file_bytes long"
BROKEN = [
    ({}, []), ({"planned_variant": None, "planned_street": None}, ["outside the plan"]), ({"has_plan": False, "planned_variant": None}, []), ({"variant": "whisper"}, ["unknown variant"]), ({"street": "t"}, ["unlike the plan"]), ({"status": "lost"}, ["unknown status"]), ({"status": None}, ["unknown status"]),
    ({"reference_raw": " "}, ["empty raw reference"]), ({"reference": None}, ["empty reference"]), ({"audio": None}, ["no path"]), ({"there": False}, ["missing file"]), ({"readable": False}, ["unreadable file"]), ({"wav_rate": 16_000, "duration": 0.5}, ["sample rate"]), ({"wav_channels": 2, "file_bytes": 99_999}, ["channels"]),
    ({"wav_bytes": 1}, ["sample width"]), ({"codec": "ULAW"}, ["compressed"]), ({"frames": 0, "duration": 0.0}, ["zero duration"]), ({"file_bytes": 100}, ["truncated file"]), ({"duration": 1.2}, ["duration differs"]), ({"duration": None}, ["duration differs"]), ({"rate": 44_100}, ["recorded sample rate"]), ({"channels": 2}, ["recorded channels"]),
    ({"status": "skipped"}, ["skipped with a file"]), ({"status": "skipped", "audio": None, "reference": ""}, []), ({"rate": None, "channels": None}, []),
]


def test_every_manifest_rule(spark):
    rows = spark.createDataFrame([tuple((GOOD | change).values()) for change, _ in BROKEN], RECORD).withColumn("id", F.monotonically_increasing_id())
    ids = [r.id for r in rows.orderBy("id").collect()]
    got = {}
    for r in audit.violations(rows, ["id"], audit.manifest_rules(["full", "short", "natural"])).collect():
        got.setdefault(r.id, []).append(r.rule)
    assert [sorted(got.get(i, [])) for i in ids] == [rules for _, rules in BROKEN]


def test_keys_and_positions(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], "id string")
    assert sorted((str(r.id), r.problem, r.n) for r in audit.key_problems(rows, "id").collect()) == [("", "missing id", 1), ("None", "missing id", 1), ("a", "duplicate id", 2)]
    with pytest.raises(ValueError, match="3 rows against 2"):
        positions.zip_by_position(spark.range(3), ["id"], spark.range(2).withColumnRenamed("id", "x"), ["x"])


def test_run_bookkeeping(tmp_path):
    with reports.single_writer(str(tmp_path / "lock")), pytest.raises(RuntimeError), reports.single_writer(str(tmp_path / "lock")):
        pass
    assert reports.progress(50, 200, 10.0) == "50/200 (25%), 30 s left" and reports.progress(0, 0, 1.0) == "0/0"
    assert reports.memory_megabytes()["resident"] > 10


def test_reports_and_records(spark):
    text = reports.markdown_report("Run", {"Modes": spark.createDataFrame([("a", 1.5)], "mode string, x double"), "Notes": "none"})
    assert text == "# Run\n\n## Modes\n\n| mode | x |\n| --- | --- |\n| a | 1.5 |\n\n## Notes\n\nnone\n"
    record = reports.experiment_record("set", ["s", "t"], 7, [1.0, 5.0], 200, {"alpha": 0.4}, {"canonical": ["s", "t"], "canonical_plus_forms": ["s", "t", "u"]})
    assert (record["street_count"], record["acoustic_forwards"], record["canonical_hotword_count"], record["canonical_plus_forms_hotword_count"]) == (2, 7, 2, 3) and record["env"]["pyspark"]


def test_command_line(spark, tmp_path, capsys):
    assert command.main(["list"]) == 0 and "dict_detect" in capsys.readouterr().out.split()
    command.main(["sql", "filter_limit"])
    assert "LIMIT 100" in capsys.readouterr().out
    command.main(["run", "plan_select", "/root/testdata/sf0.001", "--to", str(tmp_path / "plan"), "--format", "json"])
    assert spark.read.json(str(tmp_path / "plan")).count() > 0
    with pytest.raises(SystemExit):
        command.main(["run", "nothing", "x"])
