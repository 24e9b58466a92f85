"""N-gram Jaccard join [operator 1].

Texts with the same shingle set are one class. A class's prefix are its rarest
shingles, as many as a partner within the threshold must share one of; rarity
comes from counters over all documents. Classes are joined on prefix shingles
under the length and positional filters and a suffix filter on the parities of
512 ranges (each differing parity is one shingle of difference), and every pair
left is verified once on whole sets. Each round's pairs pass all three filters
before any set is made or moved for them.

The result is a class per document, so pairs that the links found so far
already connect need no test. Rounds: first each class is tested against its
next few by size under each shared shingle, then against a few in hashed order
among those not yet connected to it, and last, exhaustively, every class outside
a shingle's largest component against all that share the shingle. Two classes
of one component are never paired again, so a group of near copies costs about
its size, and every link between components is tested. In the last round a pair
belongs to its first common shingle among the EARLY rarest of both and is made
there alone; pairs whose first is later are made once for each and put together.

The first two rounds sort by ranges of (shingle, order), so that a shingle of any
number of classes is many tasks; neighbours on two sides of a border between
tasks are left to the last round.

Sets are of 64-bit hashes; a wrong link needs a collision inside one tested
pair (below 2**-40 for sets of a thousand).

Null and empty texts have no shingles, size 0 and link with nothing, not even
each other. With fewer words than a shingle has, the whole sequence is one.
A null doc_id takes part and is no component id while another one is there.
Repeated rows are copies. Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.blocks import gathered
from quern.llm.bytetext import shingle_sets, string_slices
from quern.llm.common import by_batch, drop_staged, lean, settled, staged, staged_here, table
from quern.llm.components import components
from quern.llm.spots import key_filter

SIZE, PERCENT = 4, 85
#: Counters of how many documents hold a shingle (16 MB as they are broadcast, whatever the input).
COUNTERS = 1 << 24
RANGES = 512
NEXT_BY_SIZE, NEXT_BY_HASH, EARLY = 3, 4, 32
#: Rows of one shingle that a task holds before it gives them on, and documents whose sets are made at a time.
MOST_HELD, SETS_A_BATCH = 1 << 16, 256
#: 8 MB of ids.
BROADCAST_PAIRS = 500_000


def sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle set) of each row."""
    for first, _, buf, offsets in string_slices(column):
        for k, found in enumerate(shingle_sets(buf, offsets, size)):
            yield first + k, found


def class_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def parities(shingles: np.ndarray) -> np.ndarray:
    bits = np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=RANGES) & 1
    return np.packbits(bits.astype(np.uint8)).view(">i8").astype(np.int64)


def count_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents hold the shingles of each counter, as steps of a sixteenth of its logarithm."""

    def fill(cells: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in range(0, batch.num_rows, SETS_A_BATCH):
            found = [x for _, x in sets_of(batch.column(0).slice(part, SETS_A_BATCH), size)]
            spots, times = np.unique((np.concatenate(found) & np.uint64(COUNTERS - 1)).astype(np.int64), return_counts=True)
            cells[spots] = np.minimum(cells[spots] + times, np.iinfo(cells.dtype).max)

    counts = gathered(docs.select("text"), fill, COUNTERS, "uint16", "uint32")
    steps = np.empty(COUNTERS, np.uint8)
    for k in range(0, COUNTERS, 1 << 20):  # a part at a time, for the driver's memory
        steps[k : k + (1 << 20)] = np.minimum(16 * np.log2(1.0 + counts[k : k + (1 << 20)]), 255)
    return steps


def signed_documents(docs: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, key, node, prefix, parity): the class of each document and its prefix, rarest first."""
    rarity = docs.sparkSession.sparkContext.broadcast(counts)
    schema = "doc_id bigint, n bigint, key binary, node bigint, prefix array<bigint>, parity array<bigint>"

    def step(batch: pa.RecordBatch):
        rows: tuple[list, ...] = ([], [], [], [], [])
        for _, found in sets_of(batch.column(1), size):
            n = len(found)
            key = class_key(found)
            order = np.lexsort((found, rarity.value[(found & np.uint64(COUNTERS - 1)).astype(np.int64)]))[: prefix_size(n, percent) if n else 0]
            for into, x in zip(rows, (n, key, int.from_bytes(key[:8], "little", signed=True), found[order].view(np.int64), parities(found)), strict=True):
                into.append(x)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return by_batch(docs.select("doc_id", "text"), step, schema)


def _may_link(a: str, b: str, percent: int):
    """Length and positional filters on rows of two prefixes that meet at positions `pos`, counted from 0."""
    na, nb, pa_, pb = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    need = F.floor((percent * (na + nb) + 99 + percent) / (100 + percent))
    length = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return length & (1 + F.least(na - pa_ - 1, nb - pb - 1) >= need - F.least(pa_, pb))


def _may_link_rows(a: dict[str, np.ndarray], b: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """The same on arrays."""
    na, nb = a["n"], b["n"]
    need = (percent * (na + nb) + 99 + percent) // (100 + percent)
    length = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return length & (1 + np.minimum(na - a["pos"], nb - b["pos"]) - 1 >= need - np.minimum(a["pos"], b["pos"]))


def _may_link_suffix(a: str, b: str, percent: int):
    """The suffix filter: as many parities may differ as shingles of two sets of these sizes that link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.element_at(f"{a}.parity", k).bitwiseXOR(F.element_at(f"{b}.parity", k))) for k in range(2, RANGES // 64 + 1)), F.bit_count(F.element_at(f"{a}.parity", 1).bitwiseXOR(F.element_at(f"{b}.parity", 1))))
    return apart <= na + nb - 2 * F.floor((percent * (na + nb) + 99 + percent) / (100 + percent))


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the suffix filter on classes(node, n, parity) leaves."""
    mark = lambda node, name: classes.select(F.col("node").alias(node), F.struct("n", "parity").alias(name))
    return pairs.join(mark("a", "l"), "a").join(mark("b", "r"), "b").where(_may_link_suffix("l", "r", percent)).select("a", "b")


NEIGHBOURS = "a bigint, b bigint, token bigint, n bigint, pos bigint"


def neighbours(rows: DataFrame, order: tuple[str, ...], most: int, percent: int, grouped: bool) -> DataFrame:
    """Pairs (a, b) of rows(token, node, n, pos, component) that stand at most `most` apart in `order` under one token, may link and are in two components.

    With `grouped` also a row (a, null, token, n, pos) for each row of a token
    with more rows than are all paired here.
    """
    names = ("token", "node", "n", "pos", "component")
    rows = rows.repartitionByRange("token", *order, "node").sortWithinPartitions("token", *order, "node").select(*names)
    kinds = [pa.int64()] * 5

    def out(*columns: np.ndarray | None) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in NEIGHBOURS.split(", ")])

    def pairs(now: dict[str, np.ndarray], fresh: int) -> pa.RecordBatch:
        """Pairs whose second row is at `fresh` or after it."""
        found = [(now["node"][:0], now["node"][:0])]
        for k in range(1, most + 1):
            second = np.arange(max(fresh, k), len(now["node"]))
            second = second[(now["token"][second] == now["token"][second - k]) & (now["component"][second] != now["component"][second - k])]
            x, y = ({c: now[c][at] for c in ("node", "n", "pos")} for at in (second - k, second))
            kept = _may_link_rows(x, y, percent)
            found.append((x["node"][kept], y["node"][kept]))
        a, b = (np.concatenate([f[j] for f in found]) for j in (0, 1))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        return out(a[new], b[new], None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        tail, open_group, first = {c: np.zeros(0, np.int64) for c in names}, {c: np.zeros(0, np.int64) for c in names}, True
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
            yield pairs({c: np.concatenate([tail[c], own[c]]) for c in names}, len(tail["node"]))
            tail = {c: np.concatenate([tail[c], own[c]])[-most:] for c in names}
            if grouped:
                # groups that end here; the last one is held back, and a part's first and last may go on in the next part
                now = {c: np.concatenate([open_group[c], own[c]]) for c in names}
                starts = np.flatnonzero(np.diff(now["token"], prepend=now["token"][0] - 1))
                sizes = np.diff(np.append(starts, len(now["token"])))
                large = sizes > most + 1
                if first:
                    large[0] = True
                if len(starts) > 1:
                    done = int(starts[-1])
                    kept = np.flatnonzero(np.repeat(large, sizes)[:done])
                    yield out(now["node"][kept], None, now["token"][kept], now["n"][kept], now["pos"][kept])
                    first, open_group = False, {c: now[c][done:] for c in names}
                elif len(now["token"]) > MOST_HELD:
                    yield out(now["node"], None, now["token"], now["n"], now["pos"])
                    open_group = {c: now[c][:0] for c in names}
                    first = True
                else:
                    open_group = now
        if grouped:
            yield out(open_group["node"], None, open_group["token"], open_group["n"], open_group["pos"])

    return rows.mapInArrow(run, NEIGHBOURS)


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def class_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the classes in wanted(node), from the documents' whole texts.

    Documents pass a fixed-size filter of bits; what passes it wrongly is
    dropped by the joins that follow.
    """

    known = key_filter(wanted.select("node"), wanted.count())

    def step(batch: pa.RecordBatch):
        for part in range(0, batch.num_rows, SETS_A_BATCH):
            found = [x for _, x in sets_of(batch.column(0).slice(part, SETS_A_BATCH), size) if len(x)]
            nodes = np.array([int.from_bytes(class_key(x)[:8], "little", signed=True) for x in found], np.int64)
            kept = np.flatnonzero(known(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array([found[k].tobytes() for k in kept], pa.binary())], ["node", "shingles"])

    return by_batch(docs.select("text"), step, "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link.

    Up to BROADCAST_PAIRS pairs go to the sets, so that only sets in a pair
    move; more are joined by shuffle.
    """
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    if pairs.count() <= BROADCAST_PAIRS:
        few = F.broadcast(pairs)
        both = x.join(few, "a").join(y.join(few, "b"), ["a", "b"])
    else:
        both = pairs.join(x, "a").join(y, "b")

    def step(batch: pa.RecordBatch):
        kept = []
        for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                kept.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(kept, pa.int32()))

    return by_batch(both.select("a", "b", "x", "y"), step, "a bigint, b bigint")


def ngram_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_shingles, component_id)."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    at = len(staged_here())
    counts = count_shingles(docs, size)
    gc.collect()  # Python's cycles hold the counters' frames, and those their shuffles
    settled(spark)
    signed = staged(signed_documents(docs, size, percent, counts), "signed")
    settled(spark)
    scratch = staged_here()[at:]
    own = staged(signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")), "own")
    classes = staged(signed.where("n > 0").groupBy("key", "node", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")), "classes")
    # prefixes of copies go; what is done with is given up as soon as possible
    drop_staged(spark, scratch)
    settled(spark)
    tokens = classes.select("node", F.posexplode("prefix").alias("pos", "token"), "n", F.col("node").alias("component"))
    met = staged(neighbours(tokens, ("n", "pos"), NEXT_BY_SIZE, percent, True), "shared")

    # the tests by size are all there is for a shingle of few classes; the later rounds see the others
    tried = staged(alike(_pairs(met.where("b IS NOT NULL").select("a", "b")), classes, percent), "pairs")
    settled(spark)
    shared = met.where("b IS NULL").select("token", F.col("a").alias("node"), "n", "pos")
    nodes = shared.select("node").unionAll(tried.select("a")).unionAll(tried.select("b")).distinct()
    wanted = staged(nodes.join(classes.select("node", "parity", F.slice("prefix", 1, EARLY).alias("early")), "node"), "wanted")
    sets = staged(class_sets(docs, wanted, size), "sets")
    settled(spark)
    links = lambda pairs: verified(pairs, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
    stars = lambda known: known.select(F.col("node").alias("u"), F.col("component").alias("v"))

    def still_open(known: DataFrame) -> DataFrame:
        """The rows of shared shingles that meet more than one component."""
        rows = shared.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
        return staged(rows.join(mixed, "token"), "open")

    known = components(links(tried))
    settled(spark)
    rows = still_open(known)
    met = neighbours(rows.withColumn("order", F.xxhash64("node")), ("order",), NEXT_BY_HASH, percent, False)
    more = staged(alike(_pairs(met.select("a", "b")).join(tried, ["a", "b"], "left_anti"), classes, percent), "pairs")
    tried = tried.unionAll(more)
    known = components(stars(known).unionAll(links(more)))
    settled(spark)
    rows = still_open(known)
    largest = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    rows = rows.join(largest, "token").withColumn("apart", F.col("component") != F.col("main")).drop("main").join(wanted, "node")
    before = lambda x: F.slice(f"{x}.early", F.lit(1), F.least(F.col(f"{x}.pos"), F.lit(EARLY)).cast("int"))
    once = F.col("l.apart") & (~F.col("r.apart") | (F.col("l.node") < F.col("r.node"))) & ~F.arrays_overlap(before("l"), before("r"))
    met = rows.where("apart").alias("l").join(rows.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.component") != F.col("r.component")) & _may_link("l", "r", percent) & _may_link_suffix("l", "r", percent) & once)
    last = staged(_pairs(met.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))).join(tried, ["a", "b"], "left_anti"), "pairs")
    known = components(stars(known).unionAll(links(last)))
    reps = classes.select("node", "rep")
    joined = reps.join(known, "node")
    least = joined.groupBy("component").agg(F.min("rep").alias("least"))
    ids = reps.join(joined.select("node", "component").join(least, "component").select("node", "least"), "node", "left").select("node", F.coalesce("least", "rep").alias("component_id"))
    return own.join(ids, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))
