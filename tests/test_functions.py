"""Literal values of single functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import numbers
from quern.functions import text as tx
from quern.operators import metrics, positions
from quern.sources import readers, writers
from quern.streaming.speech import FRESH, Limits, advance, segments


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_percentiles(spark):
    d = metrics.distribution(spark.range(1, 101).select(F.lit("m").alias("m"), F.col("id").cast("double").alias("x")), ["m"], "x").first()
    assert (d.n, d.p50, d.p95, d.lo, d.hi) == (100, 50.5, 95.05, 1.0, 100.0)


def test_distribution_of_nothing(spark):
    rows = spark.createDataFrame([("a", None), ("a", float("nan"))], "m string, x double")
    d = metrics.distribution(rows, ["m"], "x").first()
    assert d.n == 0 and d.mean is None and d.p99 is None


def test_numbers_in_words(spark):
    for n, words in ((0, "ноль"), (15, "пятнадцать"), (999999, "девятьсот девяносто девять тысяч девятьсот девяносто девять"), (12000, "двенадцать тысяч"), (121, "сто двадцать один")):
        assert value(spark, numbers.number_to_words(F.lit(n))) == words
        assert value(spark, numbers.digits_to_words(F.lit(f"к{n}. {n}"))) == f"к{words}. {words}"
    assert value(spark, numbers.digits_to_words(F.lit("65 и 007"))) == "шестьдесят пять и семь"
    assert value(spark, numbers.digits_to_words(F.lit(""))) == "" and value(spark, numbers.digits_to_words(F.lit(None).cast("string"))) is None
    for far in ("1000000", "9" * 30):
        with pytest.raises(Exception, match="out of range"):
            value(spark, numbers.digits_to_words(F.lit(far)))
    with pytest.raises(Exception, match="out of range"):
        value(spark, numbers.number_to_words(F.lit(1_000_000)))


def test_normal_form(spark):
    assert value(spark, tx.normalize(F.lit("Ёлка, 5 Улица-Мира!"))) == "ёлка улица мира"
    assert value(spark, tx.normalize(F.lit(None).cast("string"))) == ""


def test_containment(spark):
    assert value(spark, tx.contains_form(F.lit("a bc d"), F.lit("bc d")))
    assert not value(spark, tx.contains_form(F.lit("a bcd"), F.lit("bc")))
    assert not value(spark, tx.contains_form(F.lit("a"), F.lit("")))
    words = lambda s: F.split(F.lit(s), " ")
    assert value(spark, tx.tolerant_contains(words("на садовой улице"), words("садовая улица")))
    assert not value(spark, tx.tolerant_contains(words("на улице"), words("садовая улица")))


def test_render(spark):
    form = tx.declension(F.lit("Садовая улица"))
    assert value(spark, tx.render(F.lit("на {pre}"), form)) == "на садовой улице"
    assert value(spark, tx.render(F.lit("{pre} {acc}"), form)) is None
    assert value(spark, tx.render(F.lit("{at}"), tx.declension(F.lit("улица Мира")))) is None


def test_word_edits(spark):
    rows = spark.createDataFrame([("a b c d e", "a x c e", "m")], "reference string, hypothesis string, k string")
    d = metrics.error_rates(rows, ["k"]).first()
    assert (d.word_edits, d.wer, d.exact) == (2, 0.4, 0)


def test_bottleneck(spark):
    rows = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", 0.5), ("d", None)], "m string, share double")
    got = {r.m: r.verdict for r in metrics.bottleneck(rows, "share").collect()}
    assert got == {"a": "acoustic_model", "b": "decoder_beam_search_kenlm", "c": "mixed", "d": "unknown"}


def test_positions(spark):
    rows = positions.positional(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), ["x"], "n").collect()
    assert all(r.n == r.x + 1 for r in rows) and len(rows) == 1000


def test_json_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "a", "n": 1}\n\nnot json\n{"id": "b"}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "m.jsonl"), "id string, n int")
    assert sorted((r.id, r.n) for r in good.collect()) == [("a", 1), ("b", None)]
    assert [r.raw for r in bad.collect()] == ["not json"]


def test_lines_and_dictionary(spark, tmp_path):
    (tmp_path / "s.txt").write_text("one\n\ntwo\n")
    assert [(r.line_no, r.line) for r in readers.text_lines(spark, str(tmp_path / "s.txt")).orderBy("line_no").collect()] == [(1, "one"), (2, ""), (3, "two")]
    (tmp_path / "d.json").write_text('{"additional_forms": {"s": ["a", "b"]}}')
    assert sorted(r.form for r in readers.form_dictionary(spark, str(tmp_path / "d.json")).collect()) == ["a", "b"]


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(800) / 5).astype(np.float32) * 0.5
    data = writers.wav_bytes(x)
    (tmp_path / "a.wav").write_bytes(data)
    (tmp_path / "b.wav").write_bytes(data[:500])
    (tmp_path / "c.wav").write_bytes(b"nothing")
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.wav_headers(readers.wav_files(spark, str(tmp_path))).collect()}
    assert (rows["a.wav"].sample_rate, rows["a.wav"].frames, rows["a.wav"].truncated) == (8000, 800, False)
    assert rows["b.wav"].truncated and rows["c.wav"].error
    assert np.abs(readers.wav_samples(data) - x).max() < 1e-4


def test_export_is_all_or_nothing(spark, tmp_path):
    plan = spark.createDataFrame([("1", "train", "a", "t"), ("2", "test", "b", "u")], "id string, split string, audio string, text string")
    with pytest.raises(ValueError):
        writers.write_split_manifests(plan, plan.where("id = '1'"), str(tmp_path / "x"))
    writers.write_split_manifests(plan, plan, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x" / "split=test")).first().text == "u"


def test_flattened(spark):
    row = writers.flattened(spark.createDataFrame([([1, 2], True, None)], "a array<int>, b boolean, c string"), ["a", "b", "c", "d"]).first()
    assert tuple(row) == ("1; 2", "YES", "", "")


def speech(levels, limits=Limits()):
    state, out = FRESH, []
    for k, level in enumerate(levels):
        state, done = advance(state, k, level, limits)
        out += [done] if done else []
    return out


def test_speech_segments(spark, tmp_path):
    levels = [0] * 20 + [0.5] * 10 + [0] * 30 + [0.5] * 2 + [0] * 40
    assert speech(levels) == [(11, 52, 570), (53, 84, 270)]
    rows = spark.createDataFrame([("s", k, float(x)) for k, x in enumerate(levels)], "stream string, block long, level double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = segments(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("speech").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("speech").collect()) == [("s", 11, 52, 570), ("s", 53, 84, 270)]
    assert sorted(tuple(r) for r in segments(rows).collect()) == [("s", 11, 52, 570), ("s", 53, 84, 270)]
