"""Reports, bookkeeping and the telephone channel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import audio, reports


def test_weights():
    assert reports.parse_weights("1, 2.5,,") == [1.0, 2.5]
    with pytest.raises(ValueError):
        reports.parse_weights(" ,")


def test_table_and_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, True), ("b", None, False)], "k string, x double, ok boolean")
    assert reports.markdown_table(rows).splitlines()[2:] == ["| a | 1.5 | YES |", "| b |  | NO |"]
    with pytest.raises(ValueError):
        reports.quarantine(rows, ~F.col("ok"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "bad")).count() == 1
    assert reports.quarantine(rows, F.lit(False), str(tmp_path / "none")).count() == 2


def test_directories(tmp_path):
    assert reports.fresh_directory(str(tmp_path), "run").endswith("run")
    assert reports.fresh_directory(str(tmp_path), "run").endswith("run-2")
    with pytest.raises(ValueError, match="missing: b"):
        reports.requires(["a"], ["a", "b"])


def test_telephone():
    x = np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000) * 0.5
    y = audio.telephone(x, 1, edge_ms=100)
    assert len(y) == 9600 and not y[:800].any() and np.abs(y[800:8800] - x).max() < 0.03
    low = audio.telephone(np.sin(2 * np.pi * 100 * np.arange(8000) / 8000), 1)
    assert np.abs(low).max() < 0.01
    assert (audio.telephone(x, 7, snr_db=20) == audio.telephone(x, 7, snr_db=20)).all() and len(audio.telephone([], 1)) == 0


def test_channel(spark):
    t = np.arange(48_000) / 24_000
    tone = 0.3 * np.sin(2 * np.pi * 1000 * t)
    profiles = {"calm": audio.Profile(), "worst": audio.Profile(1, 20, 20, 1, 1, 1)}
    schema = "id string, samples array<double>, rate int, speed double, profile string, seed long"
    rows = [("a", tone.tolist(), 24_000, 1.0, "calm", 5), ("b", [0.0] * 8000, 8000, 1.0, "calm", 5), ("c", None, 8000, 1.0, "calm", 5), ("d", [0.1], 8000, 1.0, "other", 5), ("e", tone.tolist(), 24_000, 1.1, "worst", 5)]
    got = {r.id: r for r in audio.channel_rows(spark.createDataFrame(rows, schema), profiles).collect()}
    a, worst = got["a"], got["e"]
    x = np.array(a.samples)
    body = x[a.lead : len(x) - a["tail"]]
    assert a.codec == "none" and a.snr_db is None and a.clipped is False and a.gain_db == 0 and np.sqrt(np.mean(body**2)) == pytest.approx(0.09, rel=0.02)
    assert len(body) == 16_000 and not x[: a.lead].any() and all(160 <= p <= 800 for p in (a.lead, a["tail"]))
    assert worst.codec in ("pcm_mulaw", "pcm_alaw") and worst.snr_db == 20 and worst.clipped and -4 <= worst.gain_db <= 2 and np.abs(worst.samples).max() <= 1
    assert got["b"].error == got["c"].error == "silent" and got["d"].error == "unknown profile other"
    again = {r.id: r for r in audio.channel_rows(spark.createDataFrame(rows[::-1], schema).repartition(3), profiles).collect()}
    assert again == got


def test_chances_of_settings(spark):
    """Over many rows the chances come to what the profile says, and no two settings go together."""
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit(7).alias("seed"), F.lit("p").alias("profile"))
    got = audio.with_settings(rows, {"p": audio.Profile(0.3, 10, 30, 0.2, 0.5, 0.4)}).toPandas()
    shares = [got["snr_db"].notna().mean(), got["clipped"].mean(), (got["gain_db"] != 0).mean(), (got["codec"] != "none").mean()]
    assert shares == pytest.approx([0.3, 0.2, 0.5, 0.4], abs=0.03) and got["snr_db"].dropna().between(10, 30).all()
    assert (got["clipped"] & (got["codec"] != "none")).mean() == pytest.approx(0.08, abs=0.02)


@pytest.mark.parametrize("speed", [0.9, 1.0, 1.1])
def test_speed_keeps_the_pitch(speed):
    x = np.sin(2 * np.pi * 500 * np.arange(16_000) / 8000)
    y = audio.at_speed(x, speed)
    assert abs(len(y) - 16_000 / speed) <= 1
    spectrum = np.abs(np.fft.rfft(y[1000:9000]))
    assert abs(np.argmax(spectrum) - 500) <= 2


def test_a_law():
    x = np.linspace(-1, 1, 2001)
    assert np.abs(audio.a_law(x) - x).max() < 0.03 and np.abs(audio.a_law(x) - x)[np.abs(x) < 0.01].max() < 0.001
