"""Exact top-k search [operator 6]: impact-ordered score-at-a-time index.

Vectors are integers floor(256 * x). All rows are indexed in blocks of at most
BLOCK_ROWS; in a block each component has its rows in order of quantised
impact, once for positive and once for negative query weights. Queries read
posting segments of all components by descending impact, add lower bounds up,
and keep an upper bound of what is unread. A query stops only when no more than
FEW rows can still be members, which the bounds prove, or at the end; the
possible members are rescored exactly. Impacts fall by STRIDE from one reading
to the next, and the segments of a reading are one matrix, so that the queries
of a block read them in one product. A task keeps each query's best rows over
its blocks, and a row below the last of them is no member in a later block.

The query set is stated (ids divisible by QUERY_STEP) and goes block by block
against all blocks, at most BROADCAST_BYTES of it at a time; what is broadcast
or held by a task doesn't grow with the table. Vectors that are null or hold
null or non-finite values take no part; those of another length take no part
with each other. Null ids can be found (last among ties) but don't ask. Rows
with the query's id are its own. Repeated rows are separate candidates;
repeated queries ask once. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.llm.common import lean, staged, table

BLOCK_ROWS = 4096
QUERY_ROWS = 512
QUERY_STEP = 50
BEST = 5
FEW = 256
SHIFT, STRIDE = 3, 4
#: Bytes of queries that meet the blocks at a time.
BROADCAST_BYTES = 32 << 20
NULL_ID, NO_SCORE = np.iinfo(np.int64).max, np.iinfo(np.int64).min
BLOCK = "dims int, ids binary, vectors binary"


def quantised(column: pa.Array) -> list[np.ndarray | None]:
    """floor(256 * x) of each vector; None where it takes no part."""
    out = []
    for value in column.to_pylist():
        x = None if value is None or None in value else np.array(value, np.float64)
        out.append(np.floor(256 * x).astype(np.int64) if x is not None and np.isfinite(x).all() else None)
    return out


def packed(vectors: np.ndarray) -> bytes:
    """The vectors in the narrowest of 2, 4 and 8 bytes that holds them all."""
    low, high = (vectors.min(), vectors.max()) if vectors.size else (0, 0)
    return vectors.astype(next(f"<i{w}" for w in (2, 4, 8) if low >= np.iinfo(f"i{w}").min and high <= np.iinfo(f"i{w}").max)).tobytes()


def unpacked(dims: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids) // 8
    kind = f"<i{len(vectors) // (n * dims)}" if dims else "<i8"
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(n, dims).astype(np.int64)


def make_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """vectors(vec_id, embedding) in blocks of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: dict[int, tuple[list, list]] = {}

        def block(dims: int) -> pa.RecordBatch:
            ids, data = held.pop(dims)
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([packed(np.array(data, np.int64))])], ["dims", "ids", "vectors"])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), quantised(batch.column(1)), strict=True):
                if x is not None:
                    ids, data = held.setdefault(len(x), ([], []))
                    ids.append(NULL_ID if i is None else i)
                    data.append(x)
                    if len(ids) >= rows:
                        yield block(len(x))
        for dims in list(held):
            yield block(dims)

    return vectors.select("vec_id", "embedding").mapInArrow(run, BLOCK)


class Index:
    """One block: for each component and sign of the query's weight, rows by descending quantised impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.least, self.most = vectors.min(0), vectors.max(0)
        levels = np.hstack([vectors - self.least, self.most - vectors]).T >> SHIFT
        self.order = np.argsort(-levels, axis=1, kind="stable")
        self.ranked = np.take_along_axis(levels, self.order, 1)
        self.top = int(self.ranked.max(initial=0))
        # the levels at which readings end; what is below the last one adds nothing
        self.ends = [1]
        while self.ends[-1] * STRIDE <= self.top:
            self.ends.append(self.ends[-1] * STRIDE)
        self.ends.reverse()
        self.segments: dict[tuple[int, str], np.ndarray] = {}

    def segment(self, reading: int, kind: str) -> np.ndarray:
        """The postings of one reading: impacts by component and row."""
        if (reading, kind) not in self.segments:
            above = self.ends[reading - 1] if reading else self.top + 1
            own = (self.ranked < above) & (self.ranked >= self.ends[reading])
            out = np.zeros(self.ranked.shape, kind)
            component, place = np.nonzero(own)
            out[component, self.order[component, place]] = self.ranked[component, place] << SHIFT
            self.segments[reading, kind] = out
        return self.segments[reading, kind]

    def best(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows for each query but those with its id in `own`; a row that scores less than the query's `floor` may be left out."""
        n, m = len(self.ids), len(queries)
        ids, scores = np.full((m, k), NULL_ID), np.full((m, k), NO_SCORE)
        others = own[:, None] != self.ids

        def rescore(q: int, possible: np.ndarray) -> None:
            exact = self.vectors[possible] @ queries[q]
            order = np.lexsort((self.ids[possible], -exact))[:k]
            ids[q, : len(order)], scores[q, : len(order)] = self.ids[possible[order]], exact[order]

        weights = np.hstack([np.maximum(queries, 0), np.maximum(-queries, 0)])
        size = float(weights.sum(1, dtype=np.float64).max(initial=0)) * ((self.top + 1) << SHIFT)
        if n <= max(k, FEW) or not size or size >= 1 << 52:  # too few to gain anything, or sums that a double doesn't hold
            for q in range(m):
                rescore(q, np.flatnonzero(others[q]))
            return ids, scores
        kind = "float32" if size < 1 << 23 else "float64"  # bounds and their sums are integers and exact in it
        fixed = np.maximum(queries, 0) @ self.least - np.maximum(-queries, 0) @ self.most
        known = np.where(floor == NO_SCORE, -np.inf, floor.astype(np.float64) - fixed)
        left, lower = np.arange(m), np.zeros((m, n), kind)
        for reading, end in enumerate(self.ends):
            lower += weights[left].astype(kind) @ self.segment(reading, kind)
            rest = weights[left].sum(1) * ((end << SHIFT) - 1)
            # known may be no number of this kind, but rounded down it is still a bound
            least = np.nextafter((known[left] - rest).astype(kind), np.array(-np.inf, kind))
            alive = (lower >= least[:, None]) & others[left]
            many = np.flatnonzero(alive.sum(1) > max(k, FEW))
            bound = np.partition(np.where(others[left[many]], lower[many], -np.inf), n - k, axis=1)[:, n - k]
            alive[many] &= lower[many] >= (bound - rest[many])[:, None]
            done = alive.sum(1) <= max(k, FEW) if reading < len(self.ends) - 1 else np.ones(len(left), bool)
            for at in np.flatnonzero(done & alive.any(1)).tolist():
                rescore(left[at], np.flatnonzero(alive[at]))
            left, lower = left[~done], lower[~done]
            if not len(left):
                break
        return ids, scores


@lru_cache(1)
def indexed(dims: int, ids: bytes, vectors: bytes) -> Index:
    """A block's index; its query blocks come one after the other."""
    return Index(*unpacked(dims, ids, vectors))


class Asked:
    """A block of queries with the best rows found so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries = ids, queries
        self.found, self.scores = np.full((len(ids), k), NULL_ID), np.full((len(ids), k), NO_SCORE)

    def meet(self, index: Index) -> None:
        k = self.found.shape[1]
        found, scores = index.best(self.ids, self.queries, k, self.scores[:, -1])
        found, scores = np.hstack([self.found, found]), np.hstack([self.scores, scores])
        # the least of int64 has no negative; what isn't there goes last by itself
        order = np.lexsort((found, np.where(scores == NO_SCORE, NULL_ID, -np.maximum(scores, -NULL_ID))), axis=1)[:, :k]
        self.found, self.scores = np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)

    def rows(self) -> pa.RecordBatch:
        asked_by = np.array([int.from_bytes(hashlib.blake2b(q.tobytes(), digest_size=8).digest(), "little", signed=True) for q in self.queries], np.int64)
        q, place = np.nonzero(self.scores != NO_SCORE)
        vec_id = self.found[q, place]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(asked_by[q]), pa.array(vec_id, mask=vec_id == NULL_ID), pa.array(self.scores[q, place])], ["query_id", "asked_by", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = BEST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k best of vectors(vec_id, embedding) for each of queries(vec_id, embedding): query_id, rank, vec_id, score."""
    # blocks are dealt out, as the search of a block takes long and the table may be in few files
    blocks = staged(make_blocks(vectors, BLOCK_ROWS).repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism), "blocks")
    asked = staged(make_blocks(queries.where("vec_id IS NOT NULL").dropDuplicates(["vec_id", "embedding"]), QUERY_ROWS), "queries")
    size = asked.agg(F.sum(F.octet_length("ids") + F.octet_length("vectors"))).first()[0] or 0
    parts = max(1, -(-size // broadcast_bytes))
    asked = asked.select(F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.pmod(F.xxhash64("ids", "vectors"), F.lit(parts)).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        met: dict[bytes, Asked] = {}
        for batch in batches:
            for dims, ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = hashlib.blake2b(q_ids + q_data, digest_size=16).digest() + dims.to_bytes(4)
                if key not in met:
                    met[key] = Asked(*unpacked(dims, q_ids, q_data), k)
                met[key].meet(indexed(dims, ids, data))
        for one in met.values():
            yield one.rows()

    def found(part: int) -> DataFrame:
        pairs = blocks.join(F.broadcast(asked.where(F.col("part") == part)), F.col("dims") == F.col("q_dims"))
        rows = pairs.select("dims", "ids", "vectors", "q_ids", "q_vectors").mapInArrow(run, "query_id bigint, asked_by bigint, vec_id bigint, score bigint")
        rank = F.row_number().over(W.partitionBy("query_id", "asked_by").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if parts == 1:
        return found(0)
    # one after the other, so that one broadcast is there at a time
    return reduce(DataFrame.unionAll, [staged(found(part), "found") for part in range(parts)])


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
