"""Sources: typed lines, JSONL with its errors, CSV, dictionaries, WAV headers and samples, directories, settings."""

from __future__ import annotations

import hashlib
import io
import struct
import tomllib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 1, line). A file is one record, as its order means something: files of names, not corpora."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line"))
    return files.withColumn("line_no", F.col("line_no") + 1)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their raw text); blank lines are neither."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = rows.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select(F.col("value").alias("raw"))


def numbered_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """As json_lines(), with the path and line number of each row, good or bad; for manifests, which are read whole."""
    rows = text_lines(spark, path).where(F.trim("line") != "")
    parsed = rows.select("path", "line_no", "line", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("path", "line_no", "r.*").drop("_bad"), parsed.where(bad).select("path", "line_no", F.col("line").alias("raw"))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def form_dictionary(spark: SparkSession, path: str, column: str = "additional_forms") -> DataFrame:
    """(street, form) of a JSON object of lists; a file without that object raises."""
    maps = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{column} map<string, array<string>>")[column].alias("m"))
    checked = maps.select(F.when(F.col("m").isNull(), F.raise_error(F.lit(f"no object {column}"))).otherwise(F.col("m")).alias("m"))
    return checked.select(F.explode("m").alias("street", "forms")).select("street", F.explode("forms").alias("form"))


def settings(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def newest_directory(names: list[str]) -> str | None:
    """The largest name; timestamps sort as text."""
    return max(names, default=None)


#: What a usable recording has.
LEAST_SECONDS, MOST_SECONDS, LEAST_PEAK, LEAST_RMS = 0.35, 19.0, 0.005, 0.0005
WAV = "path string, sample_rate int, channels int, sample_width int, format int, frames bigint, declared_bytes bigint, file_bytes bigint, truncated boolean, error string"


def _chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(id, start, declared size) of each chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, size
        at += 8 + size + size % 2


def wav_header(path: str, data: bytes) -> tuple:
    try:
        rate = channels = width = kind = body = start = None
        for name, at, size in _chunks(data):
            if name == b"fmt ":
                kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
                width = bits // 8
            elif name == b"data":
                start, body = at, size
        if body is None or not width or not channels:
            raise ValueError("no samples")
        held = min(body, len(data) - start)
        return path, rate, channels, width, kind, held // (width * channels), start + body, len(data), start + body > len(data), None
    except (ValueError, struct.error) as e:
        return path, None, None, None, None, None, None, len(data), None, str(e)


def wav_headers(files: DataFrame) -> DataFrame:
    """Headers of files(path, content), the binaryFile source; an unreadable file is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [wav_header(p, bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in WAV.split(", ")])
            for name in ("sample_rate", "channels", "sample_width", "format", "frames", "declared_bytes"):
                frame[name] = frame[name].astype("Int64")
            yield frame

    return files.select("path", "content").mapInPandas(run, WAV)


#: Zero crossings of the resampling filter on each side, and the shape of its window.
CROSSINGS, KAISER = 16, 8.0


def resampled(x: np.ndarray, rate: int, own: int) -> np.ndarray:
    """x from `own` to `rate` samples a second by a polyphase filter that cuts what the lower rate can't hold."""
    if own == rate or not len(x):
        return np.asarray(x, np.float32)
    shared = np.gcd(rate, own)
    up, down = rate // shared, own // shared
    widest = max(up, down)
    taps = np.arange(-CROSSINGS * widest, CROSSINGS * widest + 1)
    kernel = np.sinc(taps / widest) * np.kaiser(len(taps), KAISER) * up / widest
    size, half = -(-len(x) * up // down), len(taps) // 2
    at = np.arange(size) * down
    out = np.zeros(size)
    # output sample k is the sum of x[i] * kernel[at[k] - i * up]
    for shift in range(-(half // up) - 1, half // up + 2):
        i = at // up + shift
        tap = at - i * up + half
        inside = (i >= 0) & (i < len(x)) & (tap >= 0) & (tap < len(taps))
        out[inside] += np.asarray(x, np.float64)[i[inside]] * kernel[tap[inside]]
    return out.astype(np.float32)


def _pcm(data: bytes, kind: int, width: int) -> np.ndarray:
    """Samples of a WAV body as floats; unsigned 8 bits, signed 16, 24 and 32 bits, and floats."""
    if kind == 3:
        return np.frombuffer(data, {4: "<f4", 8: "<f8"}[width]).astype(np.float64)
    if width == 1:
        return (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    if width == 3:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / 2.0**23
    return np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)


def wav_samples(data: bytes, rate: int = 8000) -> np.ndarray:
    """The samples of a WAV file as floats at `rate`, channels averaged."""
    info = {name: (at, size) for name, at, size in _chunks(data)}
    if b"fmt " not in info or b"data" not in info:
        raise ValueError("no samples")
    kind, channels, own, _, _, bits = struct.unpack_from("<HHIIHH", data, info[b"fmt "][0])
    if kind == 0xFFFE:  # fixed value: the real kind is in the extension
        kind = struct.unpack_from("<H", data, info[b"fmt "][0] + 24)[0]
    if kind not in (1, 3):
        raise ValueError(f"compressed samples, kind {kind}")
    at, size = info[b"data"]
    frame = channels * bits // 8
    body = data[at : at + size]
    return resampled(_pcm(body[: len(body) // frame * frame], kind, bits // 8).reshape(-1, channels).mean(1), rate, own)


SAMPLES = "path string, samples array<float>, file_sha256 string, samples_sha256 string, duration double, error string"


def wav_sample_rows(files: DataFrame, rate: int = 8000) -> DataFrame:
    """Samples of files(path, content) with digests of the file and of the samples; a file that can't be read is a row with its error."""

    def row(path: str, data: bytes) -> tuple:
        digest = hashlib.sha256(data).hexdigest()
        try:
            x = wav_samples(data, rate)
            return path, x.tolist(), digest, hashlib.sha256(x.astype("<f4").tobytes()).hexdigest(), len(x) / rate, None
        except (ValueError, KeyError, struct.error) as e:
            return path, None, digest, None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):  # one file's samples at a time
                yield pd.DataFrame([row(path, bytes(content))], columns=[x.split()[0] for x in SAMPLES.split(", ")])

    return files.select("path", "content").mapInPandas(run, SAMPLES)


def usable(samples: DataFrame) -> DataFrame:
    """wav_sample_rows() with what makes a recording unusable: its length, silence or values that are no numbers."""
    x = F.transform("samples", lambda v: F.abs(v.cast("double")))
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    n = F.size("samples")
    finite = F.forall(x, lambda v: ~F.isnan(v) & (v < float("inf")))
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("duration").between(LEAST_SECONDS, MOST_SECONDS), "duration")
        .when(~finite, "not finite")
        .when((F.array_max(x) < LEAST_PEAK) | (F.sqrt(squares / n) < LEAST_RMS), "silent")
    )
    return samples.withColumn("problem", problem)


def cached_arrays(files: DataFrame, name: str) -> DataFrame:
    """(path, rows, columns, values) of the array `name` in npz files(path, content), values row by row; files without it have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as held:
                    x = np.atleast_2d(held[name]) if name in held.files else None
                yield pd.DataFrame([(path, None, None, None) if x is None else (path, *x.shape, x.astype(np.float32).ravel().tolist())], columns=["path", "rows", "columns", "values"]).astype({"rows": "Int64", "columns": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, rows bigint, columns bigint, values array<float>")


def wav_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
