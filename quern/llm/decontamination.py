"""Benchmark decontamination [operator 13]: an FM-index per training shard.

`shard_indexes` turns each slice of the documents into a row that holds an
FM-index over its words (word_index.py); equal texts of a shard stand in it once.
`phrase_hits` searches test phrases backwards through the wavelet ranks of every
shard, locates their occurrences by sampled suffix positions and merges what they
cover into removal spans. A document lies in one shard, so nothing is shuffled.

Phrases travel as a broadcast of counted size; more than PHRASE_BYTES of them are
dealt into blocks by their hash. The indexes are then written once, searched for
each block, and the spans of a document's row are merged again.

A window is WINDOW words in a row of an item; an item of fewer words is one window.
Words are runs of digits, letters and everything beyond ASCII, with A-Z
lower-cased, and are compared as bytes. Null and empty texts and texts without
words have no words and no hits; very long texts are a shard of their own; equal
texts and repeated rows have equal results; items with equal windows are all
named; items of one id are one item, and an item without an id hits words but has
no name and isn't counted; without items nothing is hit; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bytetext import string_slices
from quern.llm.common import by_batch, staged, table
from quern.llm.word_index import WordIndex, words_of

#: Fixed value: words of a window.
WINDOW = 10
#: Text of a shard, and phrases of a block.
SHARD_BYTES, PHRASE_BYTES = 4 << 20, 16 << 20

INDEX = "ids array<bigint>, texts binary, sizes binary, vocabulary binary, ends binary, counts binary, levels binary, marks binary, samples binary, length bigint"
NAMES = [x.split()[0] for x in INDEX.split(", ")]


def shard_indexes(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to a row for each shard: its documents, which of its distinct texts each has, the texts' words, and the index of those that have any."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).cast(pa.int64())
        for start, count, buf, offsets in string_slices(batch.column(1), SHARD_BYTES):
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(buf)]).dictionary_encode()
            ((_, _, whole, ends),) = string_slices(texts.dictionary, len(buf) + 1)
            words, sizes = words_of(whole, ends)
            index = WordIndex.of(words, sizes[sizes > 0])
            row = [ids.slice(start, count).to_pylist(), texts.indices.to_numpy().astype(np.uint32).tobytes(), sizes.astype(np.uint32).tobytes(), *index.columns()]
            kinds = [pa.list_(pa.int64()), *[pa.binary()] * 8, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], NAMES)

    return by_batch(docs.select("doc_id", "text"), step, INDEX)


class Phrases(NamedTuple):
    """Distinct phrases as rows of numbers of their words, and the names that each has: `names[named[first[k]:first[k + 1]]]`."""

    words: pa.Array
    rows: np.ndarray
    sizes: np.ndarray
    names: list[str]
    named: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, pairs: list[tuple[str, str | None]]) -> Phrases:
        """Of (words with a blank between, name)."""
        numbers: dict[str, int] = {}
        phrases: dict[str, list[str]] = {}
        for phrase, name in pairs:
            phrases.setdefault(phrase, []).extend([] if name is None else [name])
        split = [[numbers.setdefault(w, len(numbers)) for w in p.split(" ")] for p in phrases]
        names = sorted({x for own in phrases.values() for x in own})
        at = {x: k for k, x in enumerate(names)}
        sizes = np.array([len(x) for x in split], np.int64)
        rows = np.zeros((len(split), int(sizes.max(initial=0))), np.int64)
        for k, x in enumerate(split):
            rows[k, : len(x)] = x
        first = np.append(0, np.cumsum([len(x) for x in phrases.values()])).astype(np.int64)
        return cls(pa.array([w.encode() for w in numbers], pa.large_binary()), rows, sizes, names, np.array([at[x] for own in phrases.values() for x in own], np.int64), first)


def spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of some ranges, and the range of each."""
    sizes = end - first
    which = np.repeat(np.arange(len(first)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[which]


def hits_in(index: WordIndex, sizes: np.ndarray, phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """For each text of an index its merged spans of hit words and the names of the phrases in it; sizes are the texts' words."""
    spans: list[list[tuple[int, int]]] = [[] for _ in sizes]
    names: list[list[str]] = [[] for _ in sizes]
    if not len(phrases.sizes) or not index.length:
        return spans, names
    which, low, high = index.search(index.symbols_of(phrases.words)[phrases.rows], phrases.sizes)
    of, rows = spread(low, high)
    if not len(of):
        return spans, names
    at, phrase = index.locate(rows), which[of]
    texts = np.flatnonzero(sizes)
    starts = np.append(0, np.cumsum(sizes[texts] + 1)[:-1])
    edges = np.bincount(at, minlength=index.length + 1) - np.bincount(at + phrases.sizes[phrase], minlength=index.length + 1)
    covered = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0)
    begins, ends = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
    owner = np.searchsorted(starts, begins, "right") - 1
    for t, a, b in zip(texts[owner].tolist(), (begins - starts[owner]).tolist(), (ends - starts[owner]).tolist(), strict=True):
        spans[t].append((a, b))
    owner = np.searchsorted(starts, at, "right") - 1
    met = np.unique(owner * len(phrases.sizes) + phrase)
    of, place = spread(phrases.first[met % len(phrases.sizes)], phrases.first[met % len(phrases.sizes) + 1])
    for t, k in zip(*(x.tolist() for x in np.divmod(np.unique(met[of] // len(phrases.sizes) * len(phrases.names) + phrases.named[place]), max(1, len(phrases.names)))), strict=True):
        names[texts[t]].append(phrases.names[k])
    return spans, names


HITS = "doc_id bigint, place int, n_words bigint, spans array<struct<first:int,last:int>>, names array<string>"


def phrase_hits(indexes: DataFrame, phrases: Phrases) -> DataFrame:
    """Rows of shard_indexes, with a leading `shard` or none, to a row for each document: its place in the shard, words, spans and names."""
    keyed = "shard" in indexes.columns
    shared = indexes.sparkSession.sparkContext.broadcast(phrases)
    spans_kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            texts, sizes = (np.frombuffer(row[x], np.uint32).astype(np.int64) for x in ("texts", "sizes"))
            index = WordIndex.from_columns(*(row[x] for x in NAMES[3:]))
            spans, names = hits_in(index, sizes, shared.value)
            own = texts.tolist()
            spans = [[{"first": a, "last": b} for a, b in x] for x in spans]
            columns = [pa.array(row["ids"], pa.int64()), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(sizes[texts]), pa.array([spans[t] for t in own], spans_kind), pa.array([names[t] for t in own], pa.list_(pa.string()))]
            head = [pa.array([row["shard"]] * len(own), pa.int64())] if keyed else []
            yield pa.RecordBatch.from_arrays([*head, *columns], ["shard"] * keyed + [x.split()[0] for x in HITS.split(", ")])

    return by_batch(indexes, step, ("shard bigint, " if keyed else "") + HITS)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """items(item_id, text) to distinct (phrase, name)."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, count, buf, offsets in string_slices(batch.column(1)):
            words, sizes = words_of(buf, offsets)
            words, names, at = words.cast(pa.large_string()).to_pylist(), batch.column(0).slice(start, count).to_pylist(), 0
            phrases, own = [], []
            for name, n in zip(names, sizes.tolist(), strict=True):
                for k in range(max(1, n - window + 1) if n else 0):
                    phrases.append(" ".join(words[at + k : at + min(n, k + window)]))
                    own.append(name)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(own, pa.string())], ["phrase", "name"])

    return by_batch(items.select(F.col("item_id").cast("string"), "text"), step, "phrase string, name string").distinct()


def merged(spans: Column) -> Column:
    """Sorted spans of several lists as maximal ones."""
    one = lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= x["first"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last")))),
    ).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.expr("CAST(array() AS array<struct<first:int,last:int>>)"), one)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_words, spans, names): maximal spans of words inside any occurrence of a window of items(item_id, text), and the ids of the items found."""
    pairs = staged(item_windows(items, window), "phrases")
    total = pairs.agg(F.sum(F.octet_length("phrase") + F.coalesce(F.octet_length("name"), F.lit(0)))).first()[0] or 0
    blocks = -(-total // phrase_bytes) or 1
    block = lambda k: Phrases.of([tuple(r) for r in pairs.where(F.pmod(F.xxhash64("phrase", "name"), F.lit(blocks)) == k).collect()])
    if blocks == 1:
        return phrase_hits(shard_indexes(docs), block(0)).drop("place")
    indexes = staged(shard_indexes(docs).select(F.monotonically_increasing_id().alias("shard"), "*"), "indexes")
    found = phrase_hits(indexes, block(0))
    for k in range(1, blocks):
        found = found.unionAll(phrase_hits(indexes, block(k)))
    each = found.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("names")).alias("names"))
    return each.select("doc_id", "n_words", merged(F.col("spans")).alias("spans"), F.array_distinct("names").alias("names"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    digest = F.sha2(F.array_join(F.array_sort("names"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("names").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, CAST([] AS VARCHAR[])) AS w FROM documents
), items AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, p, p + {WINDOW - 1}), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) AS p FROM items WHERE len(w) > 0)
), grams AS (
  SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS MATERIALIZED (
  SELECT r, n, p, item_id FROM grams JOIN windows USING (n, g)
), hit AS (
  SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS spot FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
