"""A dataset of JSON manifests with the audio files that their rows name, as a Python data source.

    spark.dataSource.register(ManifestSource)
    spark.read.format("audio_manifest").option("manifests", "/data/train.jsonl,/data/test.jsonl").load()

Partitions are planned over the manifests' bytes: a shard is a range of one
file's lines of about `shard_bytes`, so a task reads its lines and their audio
files and nothing else. Files are opened through pyarrow's file systems by their
URI or path. A row has the manifest's `audio` and `text`, its split (the
manifest's name), the audio file's bytes, and an error where that can't be read.
Audio paths are relative to the manifest's folder unless they are whole.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "split string, line_start bigint, audio string, text string, content binary, error string"
SHARD_BYTES = 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Shard(NamedTuple):
    path: str
    start: int
    end: int


class ShardPartition(InputPartition):
    def __init__(self, shard: Shard):
        super().__init__(shard)


def shards(path: str, shard_bytes: int) -> list[Shard]:
    """Ranges of a manifest's bytes; a line belongs to the range in which it starts."""
    files, name = opened(path)
    size = files.get_file_info(name).size
    return [Shard(path, at, min(size, at + shard_bytes)) for at in range(0, size or 0, shard_bytes)]


def lines_of(shard: Shard) -> Iterator[tuple[int, bytes]]:
    """(start, line) of the lines that start in a shard; the first task of a file starts with it, the others after the first line end at or before theirs."""
    files, name = opened(shard.path)
    with io.BufferedReader(files.open_input_file(name)) as held:
        at = shard.start
        if at:
            held.seek(at - 1)
            at += len(held.readline()) - 1
        held.seek(at)
        while at < shard.end:
            line = held.readline()
            if not line:
                return
            yield at, line
            at += len(line)


class ManifestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p.strip() for p in options["manifests"].split(",") if p.strip()]
        self.shard_bytes = int(options.get("shard_bytes", SHARD_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [ShardPartition(s) for p in self.paths for s in shards(p, self.shard_bytes)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        shard: Shard = partition.value
        folder, _, name = shard.path.rpartition("/")
        split = name.rsplit(".", 1)[0]
        for start, line in lines_of(shard):
            if not line.strip():
                continue
            try:
                row = json.loads(line)
                audio, text = row["audio"], row.get("text")
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                yield split, start, None, None, None, f"line: {type(e).__name__}"
                continue
            try:
                files, path = opened(audio if audio.startswith("/") or "://" in audio else f"{folder}/{audio}")
                with files.open_input_file(path) as held:
                    yield split, start, audio, text, held.read(), None
            except (OSError, AttributeError) as e:
                yield split, start, audio if isinstance(audio, str) else None, text, None, f"audio: {type(e).__name__}"


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio_manifest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ManifestReader(self.options)
