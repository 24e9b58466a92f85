"""Sinks: split manifests, flat CSV, appended and pretty JSON, per-mode trees, WAV bytes."""

from __future__ import annotations

import io
import os
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split_manifests(plan: DataFrame, verified: DataFrame, folder: str, key: str = "id") -> None:
    """(audio, text) JSON by split, all or nothing: any planned row that isn't verified stops the export."""
    missing = plan.join(verified.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise ValueError("plan rows without a verified artifact")
    plan.join(verified.select(key), key, "left_semi").select("split", "audio", "text").write.partitionBy("split").mode("overwrite").json(folder)


def flattened(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed columns as text: arrays joined by "; ", booleans YES and NO, null empty, missing columns empty."""
    kinds = dict(df.dtypes)

    def flat(c: str):
        if c not in kinds:
            return F.lit("").alias(c)
        x = F.col(c)
        if kinds[c].startswith("array"):
            x = F.array_join(x.cast("array<string>"), "; ")
        elif kinds[c] == "boolean":
            x = F.when(x, "YES").when(~x, "NO")
        return F.coalesce(x.cast("string"), F.lit("")).alias(c)

    return df.select(*[flat(c) for c in columns])


def write_csv(df: DataFrame, columns: list[str], folder: str) -> None:
    flattened(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


def append_json(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def pretty_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("json"))


def write_modes(rows: DataFrame, folder: str) -> None:
    rows.write.partitionBy("kind", "mode").mode("overwrite").json(folder)


def wav_bytes(samples: np.ndarray, rate: int = 8000) -> bytes:
    """Mono PCM16; values beyond full scale are clipped."""
    data = np.floor(np.clip(samples, -1, 1) * 32767 + 0.5).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def npz_bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def write_files(files: DataFrame, folder: str) -> None:
    """files(name, content) as files of their own under a local or mounted folder, each written beside its place and moved there."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.{uuid.uuid4().hex}.tmp", "wb") as f:
                    f.write(content)
                os.replace(f.name, path)
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("name", "content").mapInPandas(run, "n bigint").agg(F.sum("n")).collect()
