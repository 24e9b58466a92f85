"""Vector code compression [operator 12]: product codes by partial-distance search.

A vector of integers is cut into equal parts, and each part becomes the index of
the nearest entry of its codebook. The search goes through a part's dimensions
in descending variance over the codebook, for all vectors of a batch at once: a
mask drops a vector's entry as soon as its accumulated distance strictly exceeds
the best complete distance so far; entries that tie stay, and the lower index
wins. The best starts with a complete distance of the entry that is nearest in
the first dimension.

Codebooks are trained over all vectors: tasks add their sums and counts of each
entry (arrays whose size doesn't depend on the input), Spark adds those of the
tasks, and the driver divides. A round reads the staged integers once. All
arithmetic is on integers, so a rerun or another partitioning gives the same.

Vectors that are null or hold null or non-finite components take no part, nor
do those of another length than the vector of the smallest kept id, or whose
length isn't a multiple of the number of parts; without vectors there are no
rows. Null ids come last, and rows of one id are taken in the order of their
vectors. With fewer vectors than entries a codebook has as many entries as there
are. Components beyond 2**26 once scaled raise an error, as their squares don't
fit. Repeated rows are rows like others; null labels are one label; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import by_batch, lean, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MOST = 1 << 26


def kept_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding, label) to the rows that take part, with floor(scale * component) as `ints`."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & finite).select("vec_id", "label", ints.alias("ints"))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's integer lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(part: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for each row of `part`, the lower index where they tie."""
    rows, entries = len(part), len(codebook)
    if not part.shape[1]:
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    spread = codebook.astype(float).var(axis=0)
    order = np.argsort(-spread, kind="stable")
    x, book = np.ascontiguousarray(part[:, order].T), codebook[:, order].T
    # a complete distance to begin with: the entry nearest in the first dimension
    by_first = np.argsort(book[0], kind="stable")
    at = np.clip(np.searchsorted(book[0][by_first], x[0]), 0, entries - 1)
    index = by_first[at]
    best = sum((x[d] - book[d][index]) ** 2 for d in range(len(order)))
    for entry in range(entries):
        alive = np.arange(rows)
        distance = (x[0] - book[0, entry]) ** 2
        for d in range(1, len(order)):
            inside = distance <= best[alive]
            if not inside.all():
                alive, distance = alive[inside], distance[inside]
            distance = distance + (x[d][alive] - book[d, entry]) ** 2
        wins = (distance < best[alive]) | ((distance == best[alive]) & (entry < index[alive]))
        index[alive[wins]], best[alive[wins]] = entry, distance[wins]
    return index, best


def assigned(rows: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes [row, part] and each row's error by codebooks [part, entry, place]."""
    width = codebooks.shape[2]
    found = [nearest(rows[:, k * width : (k + 1) * width], book) for k, book in enumerate(codebooks)]
    return np.stack([x[0] for x in found], axis=1), sum(x[1] for x in found)


def entry_sums(vectors: DataFrame, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts [part, entry] and sums [part, entry, place] of the parts nearest to each entry.

    A task sends one row for each part and entry; Spark adds them by position.
    """
    parts, entries, width = codebooks.shape
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(0))
            codes, _ = assigned(rows, shared.value)
            for k in range(parts):
                counts[k] += np.bincount(codes[:, k], minlength=entries)
                np.add.at(sums[k], codes[:, k], rows[:, k * width : (k + 1) * width])
        at = np.repeat(np.arange(parts * entries, dtype=np.int32), width + 1)
        place = np.tile(np.arange(-1, width, dtype=np.int32), parts * entries)
        values = np.concatenate([counts[..., None], sums], axis=2).ravel()
        used = values != 0
        yield pa.RecordBatch.from_arrays([pa.array(at[used]), pa.array(place[used]), pa.array(values[used])], ["entry", "place", "value"])

    added = vectors.select("ints").mapInArrow(run, "entry int, place int, value bigint").groupBy("entry", "place").agg(F.sum("value").alias("value"))
    out = np.zeros((parts * entries, width + 1), np.int64)
    for row in added.collect():  # parts * entries * (width + 1) numbers at most
        out[row.entry, row.place + 1] = row.value
    return out[:, 0].reshape(parts, entries), out[:, 1:].reshape(parts, entries, width)


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks [part, entry, place] of vectors(vec_id, ints); None where there are none."""
    first = vectors.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    if not first:
        return None
    codebooks = np.array([r.ints for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)
    for _ in range(rounds):
        counts, sums = entry_sums(vectors, codebooks)
        codebooks = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], codebooks)
    return codebooks


def usable(vectors: DataFrame, parts: int) -> DataFrame:
    """Rows of the length of the vector with the smallest id, if that can be cut into parts; ValueError where components are too large."""
    rows = staged(vectors, "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select(F.size("ints").alias("n")).first()
    if first is None or first.n % parts:
        return rows.limit(0)
    if not rows.where(F.exists("ints", lambda x: F.abs(x) > MOST)).isEmpty():
        raise ValueError(f"components beyond {MOST} once scaled")
    return rows.where(F.size("ints") == first.n)


def coded(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vectors(vec_id, label, ints) to (vec_id, label, code, error); codes are an index a part, two hex digits each."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes, errors = assigned(matrix(batch.column(2)), shared.value)
        text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return by_batch(vectors.select("vec_id", "label", "ints"), step, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding, label) to (vec_id, code, error, label_error, codebooks_sha256)."""
    rows = usable(kept_vectors(vectors, scale), parts)
    codebooks = trained(rows, parts, entries, rounds)
    if codebooks is None:
        codebooks = np.zeros((parts, 1, 0), np.int64)
    found = staged(coded(rows, codebooks), "codes")
    sums = staged(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    both = found.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _rounds_sql() -> str:
    """One pair of steps for each round: the entry of each part, then the entries as floors of means."""
    out = []
    for k in range(ROUNDS + 1):
        out.append(
            f"""a{k} AS MATERIALIZED (
  SELECT row, part, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
    SELECT row, part, e, CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS d FROM points p JOIN b{k} b USING (part, place) GROUP BY row, part, e
  ) GROUP BY row, part
)"""
        )
        if k < ROUNDS:
            out.append(
                f"""b{k + 1} AS MATERIALIZED (
  SELECT part, e, place, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT part, e, place, CAST(sum(x) // count(*) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS x
    FROM points JOIN a{k} USING (row, part) GROUP BY part, e, place
  ) m USING (part, e, place)
)"""
            )
    return ",\n".join(out)


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (
  SELECT row, len(embedding) // {PARTS} AS width, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM kept
), points AS MATERIALIZED (
  SELECT row, i // width AS part, i % width AS place, CAST(floor(CAST(v AS DOUBLE) * {SCALE}) AS BIGINT) AS x FROM flat
), b0 AS MATERIALIZED (
  SELECT part, row - 1 AS e, place, x FROM points WHERE row <= {ENTRIES}
), {_rounds_sql()}, codes AS (
  SELECT row, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row
), digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, place)) AS codebooks_sha256 FROM b{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (row), digest
"""
