"""The training-data pipeline, a part of the subpackage `llm`.

Each stage takes all that its predecessor kept as `docs` (the columns of
`documents`), and all but the last give the same columns. Stages: documents
that the language model rejects go; one document of each near-duplicate class
stays; passages of over 50 words that start elsewhere, too, are cut out, and a
document left without a word goes; sources are mixed to their targets, where a document taken twice is
two rows; the last stage gives token ids.

Null, empty and blank texts have no words: the language model rejects them in
the first stage, and without trusted text, where it judges nothing, the third
drops them. Rows are told apart by their place, so repeated and null ids stay
apart: copies are near duplicates of each other, of which one row stays, the
first read. Very long texts are rows like any other. Extra columns are dropped
at the first stage, whatever their names. An empty table gives empty stages.
Stages may be chained without writing what is between: scratch tables that a
stage's input still reads stay until a later stage begins, or the process ends.
"""

from __future__ import annotations

import functools
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ngram_join, quality_lm, repeated_bytes, sentence_pieces, source_mix
from quern.llm.bytetext import find_words
from quern.llm.common import by_batch, drop_at_exit, drop_staged, settled, shared_dir, staged, staged_here, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: words of a shingle and percent of similarity. Repeated passages: words.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
PASSAGE_WORDS = 51


class _Left(threading.local):
    """For each data folder what the stage before has staged in this thread."""

    def __init__(self):
        self.paths: dict[str, list[str]] = {}


_LEFT = _Left()


def stage(function):
    """A stage that drops its predecessor's scratch tables first, but for those that its own input still reads."""

    @functools.wraps(function)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.paths.setdefault(sf_dir, [])
        read = {part for file in (docs.inputFiles() if left else []) for part in file.split("/")}
        needed = [path for path in left if path.rpartition("/")[2] in read]
        if not needed:
            drop_staged(spark, left)
        before = len(staged_here())
        result = function(spark, docs, sf_dir)
        left.extend(staged_here()[before:])
        return result

    return begin


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a key `row` of its own for each row, kept in a table, so that repeated and null ids stay apart."""
    return staged(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def as_documents(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.col("row").alias("doc_id"), "text", "lang", "source")


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    trusted = rows.select("row", "doc_id").join(labels, "doc_id", "left_semi").select(F.col("row").alias("doc_id"), F.lit(1).alias("quality"))
    judged = quality_lm.judge(quality_lm.score_documents(as_documents(rows), trusted))
    return rows.join(judged.where("keep").select(F.col("doc_id").alias("row")), "row", "left_semi").select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    at = len(staged_here())
    classes = ngram_join.ngram_components(as_documents(rows), SHINGLE_WORDS, SIMILAR_PERCENT)
    scratch = staged_here()[at:]
    first = staged(classes.where("doc_id = component_id").select(F.col("doc_id").alias("row")), "first")
    # sets and prefixes go before whole texts move
    drop_staged(spark, scratch)
    settled(spark)
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words from first to before last of each span, and without the blanks between them."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = find_words(data, np.array([0, len(data)]))
    out, at = [], 0
    for first, last in spans:
        out.append(data[at : starts[first]].tobytes())
        at = ends[last - 1]
    return b"".join([*out, data[at:].tobytes()]).decode()


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    keyed, cuts, _ = repeated_bytes.repeated_spans(as_documents(rows), (repeated_bytes.Depth(PASSAGE_WORDS, True),))
    spans = keyed.join(staged(cuts, "cuts"), "node").select(F.col("doc_id").alias("row"), "whole", "spans")
    cut = rows.join(spans, "row", "left").where("whole IS NULL OR NOT whole").select(*COLUMNS, "spans")

    def step(batch: pa.RecordBatch):
        texts = [x if s is None or x is None else without_words(x, [(y["first"], y["last"]) for y in s]) for x, s in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        n = [None if x is None else len(x) for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string()), batch.column(2), batch.column(3), pa.array(n, pa.int64())], list(COLUMNS))

    kept = by_batch(cut, step, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return kept.where(source_mix.token_count() > 0)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    mixed = source_mix.mix_sources(as_documents(rows)).where("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    return rows.join(mixed, "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokens),
]

#: No stage but the last can be told in SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}-stage"
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        docs.write.parquet(f"{home}-{k}")
        docs = spark.read.parquet(f"{home}-{k}")
        if k:  # what a stage has read goes when its result is written
            drop_staged(spark, [f"{home}-{k - 1}"])
    drop_at_exit(f"{home}-{len(STAGES) - 1}")
    return docs
