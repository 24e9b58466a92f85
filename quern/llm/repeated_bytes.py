"""Suffix-array dedup [operator 9]: depth-limited radix sort.

Suffixes are only told apart through their first `length` units, by
most-significant-digit passes whose digits are 64-bit fingerprints of ranges;
suffixes still equal after the last pass are exactly the repeated windows (up
to fingerprint collisions, about 2**-64 for a pair). A unit is a byte, or a word
(its bytes; the blanks between words don't count). Several depths are sorted in
the same passes, each with fingerprints of its own.

Pass 1 needs one digit per anchor, not per suffix. In every window the anchor is
the leftmost of its smallest grams, which depends on the window alone, so equal
windows have equal anchors at equal places. Windows in a row with the same
anchor are one run; only grams that occur again go on. Pass 2 takes the whole
run as digit: where its span occurs again, all its windows do. Pass 3 splits
runs of grams that occur in several spans into single windows, one run for each
distinct span standing for all its copies. Each pass groups small rows with
map-side counts and the texts themselves move only where a document is cut in
part or a run is split, so a passage in a third of all documents is a count.

The query removes bytes by windows of 400 bytes. A passage of over 50 words can
be shorter than that, so it also counts the words that lie in a stretch of
PASSAGE_WORDS words that starts anywhere else, too (n_repeated_words), and says
whether there are any (is_repeated).

Null and empty texts have no units and keep none; texts shorter than `length`
are kept; very long texts are one row like any other. Repeated rows and equal
texts are occurrences of each other and vanish if long enough. Rows with a null
doc_id count and are returned. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bytetext import find_words, prefix_sums, range_hash, running_sums, string_slices
from quern.llm.common import by_batch, lean, settled, staged, table
from quern.llm.spots import key_filter

LENGTH, PASSAGE_WORDS = 400, 51
#: Windows of a shard, about, and windows packed at a time.
SHARD_WINDOWS, FLUSH_WINDOWS = 1 << 20, 1 << 19


class Depth(NamedTuple):
    """How many units a window has, and how many of them a gram."""

    length: int
    words: bool = False

    @property
    def gram(self) -> int:
        return max(1, self.length // 3) if self.words else self.length // 2


class Units(NamedTuple):
    """The units of some texts: running sums of their codes, and where each text's units start and end."""

    sums: np.ndarray
    borders: np.ndarray
    #: Byte ranges of words; None where units are bytes.
    starts: np.ndarray | None
    ends: np.ndarray | None


def units_of(buf: np.ndarray, offsets: np.ndarray, words: bool, sums: np.ndarray | None = None) -> Units:
    """sums are the running sums of the bytes, where these are known."""
    sums = prefix_sums(buf) if sums is None else sums
    if not words:
        return Units(sums, offsets, None, None)
    starts, ends, first = find_words(buf, offsets)
    codes = range_hash(sums, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return Units(running_sums(codes), first, starts, ends)


def text_key(data) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `width` values in a row."""
    rows = -(-len(values) // width)
    padded = np.full(rows * width, values[-1], values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(rows, width)
    ahead = best.accumulate(grid, axis=1).ravel()
    behind = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


def window_runs(grams: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """grams at each position of some texts, `width` of them in a window: anchor, first and last window of each run of valid windows."""
    least = _sliding(grams, width, np.minimum)
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    spots = np.flatnonzero(grams == _sliding(around, width, np.maximum))
    windows = np.flatnonzero(valid)
    at = np.searchsorted(spots, windows)
    wrong = np.flatnonzero(grams[spots[at]] != least[windows])
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[grams[spots[at[wrong]]] != least[windows[wrong]]]
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(windows, prepend=-2) != 1))
    return spots[at[first]], windows[first], windows[np.append(first[1:], len(windows)) - 1] if len(first) else windows


ANCHORED = "doc_id bigint, node bigint, n_bytes bigint, n_words bigint, sha256 string, runs array<int>, depth array<tinyint>, gram array<bigint>, span array<bigint>, first array<int>, last array<int>"
RUN_KINDS = (pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32())


def _tagged(hashes: np.ndarray, depth: int) -> np.ndarray:
    """Fingerprints of different depths stay apart."""
    return (hashes ^ np.uint64(depth * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)


def runs_of(texts: Units, depth: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, gram, span, first, last) of the runs of all texts; windows are numbered in their text."""
    sizes = np.diff(texts.borders)
    if not texts.sums.shape[1] > length or not (sizes >= length).any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    places = np.arange(texts.sums.shape[1] - gram)
    grams = _tagged(range_hash(texts.sums, places, places + gram), depth).view(np.uint64)
    # a window that fits the text at whose unit it starts
    left = np.repeat(texts.borders[1:], sizes)[: len(places) - (length - gram)] - places[: len(places) - (length - gram)]
    anchor, first, last = window_runs(grams, length - gram + 1, left >= length)
    owner = np.searchsorted(texts.borders, first, "right") - 1
    spans = _tagged(range_hash(texts.sums, first, last + length), depth)
    return owner, grams[anchor].view(np.int64), spans, first - texts.borders[owner], last - texts.borders[owner]


def anchored(docs: DataFrame, depths: tuple[Depth, ...]) -> DataFrame:
    """Per document its text's key and digest, and its runs of windows of each depth."""

    def step(batch: pa.RecordBatch):
        ids = batch.column(0).cast(pa.int64())
        for start, count, buf, offsets in string_slices(batch.column(1)):
            nodes, digests = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                data = buf[a:b].tobytes()
                nodes.append(text_key(data))
                digests.append(hashlib.sha256(data).hexdigest())
            sums = prefix_sums(buf)
            units = {words: units_of(buf, offsets, words, sums) for words in {True, *(d.words for d in depths)}}
            found = [runs_of(units[d.words], k, d.length, d.gram) for k, d in enumerate(depths)]
            sizes = np.stack([np.bincount(x[0], minlength=count) for x in found], axis=1)
            owner = np.concatenate([x[0] for x in found])
            order = np.argsort(owner, kind="stable")
            columns = [np.repeat(np.arange(len(depths)), [len(x[0]) for x in found]), *(np.concatenate([x[j] for x in found]) for j in range(1, 5))]
            borders = pa.array(np.append(0, np.cumsum(sizes.sum(axis=1))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(borders, pa.array(c[order]).cast(kind)) for c, kind in zip(columns, RUN_KINDS, strict=True)]
            counts = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * len(depths)), pa.array(sizes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, count), pa.array(nodes, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(units[True].borders), pa.int64()), pa.array(digests), counts, *lists],
                [x.split()[0] for x in ANCHORED.split(", ")],
            )

    return by_batch(docs.select("doc_id", "text"), step, ANCHORED)


AGAIN = "node bigint, runs int, depth tinyint, gram bigint, span bigint, first int, last int"


def runs_known(rows: DataFrame, known) -> DataFrame:
    """A row for each run whose gram may occur again."""

    def step(batch: pa.RecordBatch):
        node, counts, lists = batch.column(0), batch.column(1), batch.columns[2:]
        values = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
        kept = np.flatnonzero(known(values[1]))
        owner = np.searchsorted(lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py(), kept, "right") - 1
        each = counts.flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
        own = each[owner, values[0][kept]] if len(kept) else np.zeros(0, np.int32)
        columns = [node.to_numpy(zero_copy_only=False)[owner], own.astype(np.int32), *(v[kept] for v in values)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in AGAIN.split(", ")])

    return by_batch(rows.select("node", "runs", "depth", "gram", "span", "first", "last"), step, AGAIN)


PACKED = "shard int, hashes binary, nodes binary, owners binary, starts binary, marks binary"
MATCHED = "part int, nodes binary, marks binary, starts binary"
FOUND = "node bigint, depth tinyint, starts binary"


def single_windows(texts: DataFrame, runs: DataFrame, depths: tuple[Depth, ...]) -> DataFrame:
    """(node, depth, starts) of the windows in runs(node, asked: array of depth, first, last, weight) that occur again; runs of weight 2 count but aren't returned.

    Windows go to shards of their fingerprints, packed, and what is found goes
    to as many parts of texts; there is one run for each distinct span, so no
    fingerprint fills a shard.
    """
    width = F.aggregate("asked", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    total = runs.agg(F.sum(width).alias("n")).first()["n"] or 0
    bits = max(3, min(16, (total // SHARD_WINDOWS).bit_length()))

    def pack(batches):
        lean()
        held: list[tuple] = []
        nodes: list[int] = []
        size = 0

        def flush():
            nonlocal held, nodes, size
            hashes, owners, starts, marks = (np.concatenate([x[k] for x in held]) for k in range(4))
            order = np.argsort(hashes)
            hashes, owners, starts, marks = hashes[order], owners[order], starts[order], marks[order]
            borders = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            for shard in range(1 << bits):
                p = slice(borders[shard], borders[shard + 1])
                if p.start < p.stop:
                    used, own = np.unique(owners[p], return_inverse=True)
                    yield shard, hashes[p].tobytes(), np.array(nodes, np.int64)[used].tobytes(), own.astype(np.uint32).tobytes(), starts[p].astype(np.uint32).tobytes(), marks[p].tobytes()
            held, nodes, size = [], [], 0

        def rows():
            out = list(zip(*flush(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(out)], [x.split()[0] for x in PACKED.split(", ")])

        for batch in batches:
            for node, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buf = np.frombuffer(text, np.uint8)
                for k, depth in enumerate(depths):
                    own = [x for x in asked if x["depth"] == k]
                    if own:
                        starts = np.concatenate([np.arange(x["first"], x["last"] + 1) for x in own])
                        weight = np.repeat([x["weight"] for x in own], [x["last"] + 1 - x["first"] for x in own])
                        hashes = _tagged(range_hash(units_of(buf, np.array([0, len(buf)]), depth.words).sums, starts, starts + depth.length), k).view(np.uint64)
                        held.append((hashes, np.full(len(starts), len(nodes), np.int64), starts, (weight << 4 | k).astype(np.uint8)))
                        size += len(starts)
                nodes.append(node)
                if size >= FLUSH_WINDOWS:
                    yield rows()
        if size:
            yield rows()

    def match(group: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in group["hashes"]])
        starts, marks = (np.concatenate([np.frombuffer(x, kind) for x in group[c]]) for c, kind in (("starts", np.uint32), ("marks", np.uint8)))
        nodes = np.concatenate([np.frombuffer(x, np.int64)[np.frombuffer(o, np.uint32)] for x, o in zip(group["nodes"], group["owners"], strict=True)])
        _, inverse = np.unique(hashes, return_inverse=True)
        again = np.bincount(inverse, marks >> 4)[inverse] > 1
        kept = np.flatnonzero(again & (marks >> 4 == 1))
        kept = kept[np.argsort(nodes[kept].view(np.uint64), kind="stable")]
        part = (nodes[kept].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        borders = np.searchsorted(part, np.arange((1 << bits) + 1))
        out = [(k, *(c[kept[borders[k] : borders[k + 1]]].tobytes() for c in (nodes, marks, starts))) for k in range(1 << bits) if borders[k + 1] > borders[k]]
        return pd.DataFrame(out, columns=[x.split()[0] for x in MATCHED.split(", ")])

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        node, depth, begin = (np.concatenate([np.frombuffer(x, kind) for x in group[c]]) for c, kind in (("nodes", np.int64), ("marks", np.uint8), ("starts", np.uint32)))
        order = np.lexsort((begin, depth, node))
        node, depth, begin = node[order], depth[order] & 15, begin[order]
        first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])))
        ends = np.append(first[1:], len(node))
        return pd.DataFrame({"node": node[first], "depth": depth[first].astype(np.int8), "starts": [begin[a:b].tobytes() for a, b in zip(first, ends, strict=True)]})

    packed = texts.join(runs, "node").select("node", "text", "asked").mapInArrow(pack, PACKED)
    return packed.groupBy("shard").applyInPandas(match, MATCHED).groupBy("part").applyInPandas(gather, FOUND)


def covered(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the units up to the last one are in some [start, end)."""
    starts, ends = starts.astype(np.int64), ends.astype(np.int64)
    n = int(ends.max(initial=0))
    return np.cumsum(np.bincount(starts, minlength=n + 1)[:n] - np.bincount(ends, minlength=n + 1)[:n]) > 0


def maximal_spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


SPANS = "array<struct<first:int,last:int>>"


def repeated_spans(docs: DataFrame, depths: tuple[Depth, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs(doc_id, text): rows (doc_id, node, n_bytes, n_words, sha256), cuts (node, depth, whole, spans), and the texts (node, text) of what is not cut whole.

    A cut's spans are the text's maximal ranges of repeated units; it is
    `whole`, without spans, where every unit is one. Texts without a cut at a
    depth have nothing repeated there.
    """
    rows = staged(anchored(docs, depths), "anchors")
    grams = staged(rows.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    settled(docs.sparkSession)
    again = staged(runs_known(rows, key_filter(grams, grams.count())).join(grams, "gram"), "again")
    settled(docs.sparkSession)
    kinds = again.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "first", "last", "depth")).alias("one"))
    mixed = again.groupBy("gram").agg(F.min("span").alias("a"), F.max("span").alias("b")).where("a < b").select("gram", F.lit(True).alias("mixed"))
    kinds = kinds.join(mixed, "gram", "left").withColumn("mixed", F.col("mixed").isNotNull())
    kinds = staged(kinds.where("n > 1 OR mixed"), "kinds")

    full = again.join(kinds.where("n > 1").select("gram", "span"), ["gram", "span"]).groupBy("node", "depth").agg(F.first("runs").alias("runs"), F.collect_set(F.struct("first", "last")).alias("full"))
    whole = F.size("full") == F.col("runs")
    full = staged(full.select("node", "depth", whole.alias("whole"), F.when(~whole, F.col("full")).alias("full")), "full")
    asked = kinds.where("mixed").select("one.node", F.struct("one.depth", "one.first", "one.last", F.when(F.col("n") > 1, 2).otherwise(1).alias("weight")).alias("x"))
    asked = staged(asked.groupBy("node").agg(F.collect_list("x").alias("asked")), "asked")

    partly = full.where("NOT whole")
    wanted = partly.where("depth = 0").select("node").unionAll(asked.select("node"))
    known = key_filter(wanted, wanted.count())

    def step(batch: pa.RecordBatch):
        data = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
        nodes = np.array([text_key(x) for x in data], np.int64)
        kept = np.flatnonzero(known(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array([data[k] for k in kept], pa.binary())], ["node", "text"])

    texts = by_batch(docs.select("text"), step, "node bigint, text binary").groupBy("node").agg(F.first("text").alias("text"))
    texts = staged(texts, "texts")
    single = staged(single_windows(texts, asked, depths), "starts")
    settled(docs.sparkSession)
    inputs = partly.select("node", "depth", "full").join(single, ["node", "depth"], "full").select("node", "depth", "full", "starts")

    def cut(batch: pa.RecordBatch):
        columns, spans = batch.columns, []
        for depth, full, starts in zip(*(c.to_pylist() for c in columns[1:]), strict=True):
            length = depths[depth].length
            single = np.frombuffer(starts or b"", np.uint32).astype(np.int64)
            first, last = maximal_spans(covered(np.append([x["first"] for x in full or []], single), np.append([x["last"] for x in full or []], single) + length))
            spans.append([{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*columns[:2], pa.array([False] * len(spans)), pa.array(spans, kind)], ["node", "depth", "whole", "spans"])

    cuts = by_batch(inputs, cut, f"node bigint, depth tinyint, whole boolean, spans {SPANS}").unionAll(full.where("whole").select("node", "depth", "whole", F.expr(f"CAST(array() AS {SPANS})").alias("spans")))
    return rows.select("doc_id", "node", "n_bytes", "n_words", "sha256"), cuts, texts


def kept_digests(texts: DataFrame, cuts: DataFrame) -> DataFrame:
    """(node, n_removed, n_spans, kept) of each cut text."""

    def step(batch: pa.RecordBatch):
        out = []
        for node, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, kept, gone = 0, hashlib.sha256(), 0
            for x in spans:
                kept.update(text[at : x["first"]])
                at, gone = x["last"], gone + x["last"] - x["first"]
            kept.update(text[at:])
            out.append((node, gone, len(spans), kept.hexdigest()))
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], ["node", "n_removed", "n_spans", "kept"])

    return by_batch(texts.join(cuts.where("NOT whole"), "node").select("node", "text", "spans"), step, "node bigint, n_removed bigint, n_spans bigint, kept string")


def removal_report(docs: DataFrame, length: int = LENGTH, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words, is_repeated)."""
    rows, cuts, texts = repeated_spans(docs, (Depth(length), Depth(passage_words, True)))
    cuts = staged(cuts, "cuts")
    own = cuts.where("depth = 0")
    whole = own.where("whole").select("node", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"))
    results = kept_digests(texts, own).unionAll(whole)
    in_spans = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    words = cuts.where("depth = 1").select("node", F.when(~F.col("whole"), in_spans).alias("in_spans"), "whole")
    results = staged(results.join(words, "node", "full"), "results")
    removed = F.when(F.col("n_spans").isNull(), F.lit(0)).otherwise(F.coalesce("n_removed", "n_bytes")).cast("long")
    repeated = F.when(F.col("whole").isNull(), F.lit(0)).otherwise(F.coalesce("in_spans", "n_words")).cast("long")
    found = rows.join(results, "node", "left")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"), repeated.alias("n_repeated_words"), (repeated > 0).alias("is_repeated"))


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))
