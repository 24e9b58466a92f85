"""Mixing sources to target weights [operator 5]: subset-sum budget fitting.

Documents are counted by source and exact length. Each source's target is met
in whole rounds of all its documents, then by a bounded knapsack over lengths:
the same share of every length first, and dynamic programming over a window at
the end of up to EXACT_BUDGET tokens (and what the longest length leaves). The
rule is the same for any budget. The chosen number of each length is then taken
in seeded hash order. What is gathered per source is a count per length, never
rows.

Null text has size 0; a null source is a source of its own and comes last; a
null doc_id takes part like any other. Repeated rows are separate documents.
Documents of size 0 take 0. An empty table gives no rows. Extra columns are
ignored. The order depends on seed, doc_id and size alone, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.llm.common import staged, table

WEIGHTS = (3, 1, 2)
SHARE, MOST_ROUNDS = 1.5, 2
EXACT_BUDGET = 1 << 16
SEED = 17
BUCKETS = 256


def token_count(text: str = "text"):
    return F.coalesce(F.expr(rf"regexp_count({text}, '[^\\x20\\x09-\\x0D]+')").cast("long"), F.lit(0).cast("long"))


def source_targets(totals: DataFrame) -> DataFrame:
    """totals(key, source, source_size) with each source's target.

    Water-filling in one ordered pass: in order of limit per weight, a source is
    limited as long as its limit is below the level that the rest would reach.
    There is a row per source, so the ordering windows see only sources.
    """
    everyone = W.partitionBy()
    weighed = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = weighed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * float(MOST_ROUNDS)).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everyone) * SHARE - F.coalesce(F.sum("limit").over(order), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    weighed = weighed.withColumn("level", level).withColumn("limited", F.col("ratio") < F.col("level"))
    first = F.first(F.when(~F.col("limited"), F.col("level")), True).over(W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return weighed.withColumn("target", F.when(F.col("limited"), F.col("limit")).otherwise(F.col("weight") * first)).select("key", "source", "source_size", "target")


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT_BUDGET) -> np.ndarray:
    """How many to take of each size, at most counts, so that the sum comes near to budget from below.

    The same share of every size comes first, which keeps the mix of lengths,
    but for a window at the end that dynamic programming fills. Where it can't
    be filled to the last token the window is widened, up to `exact` tokens; of
    the windows the fullest counts. A budget of up to `exact` is so met as well
    as it can be at all.
    """
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    best, most, window = np.zeros(len(sizes), np.int64), -1, max(1, exact >> 8)
    while True:
        take = _share(sizes, counts, total, max(0, budget - window))
        take = take + _knapsack(sizes, counts - take, budget - int((take * sizes).sum()))
        if int((take * sizes).sum()) > most:
            best, most = take, int((take * sizes).sum())
        if most == budget or window >= min(exact, budget):
            return best
        window = min(exact, window * 4)


def _share(sizes: np.ndarray, counts: np.ndarray, total: int, wanted: int) -> np.ndarray:
    """The same share of each size, and one more of those that lost most by rounding, as far as they fit."""
    shares = counts.astype(object) * wanted
    take, lost = (shares // total).astype(np.int64), shares % total
    left = wanted - int((take * sizes).sum())
    for k in np.argsort(-lost.astype(float), kind="stable"):
        if lost[k] and sizes[k] <= left:
            take[k] += 1
            left -= int(sizes[k])
    return take


def _knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack by binary splitting; by[s] is the item that first reached the sum s."""
    items = []
    for k in np.argsort(-sizes, kind="stable"):
        size, rest, bundle = int(sizes[k]), int(counts[k]), 1
        rest = min(rest, budget // size) if size else 0
        while rest > 0:
            n = min(bundle, rest)
            items.append((int(k), n, n * size))
            rest, bundle = rest - n, bundle * 2
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int32)
    for i, (_, _, weight) in enumerate(items):
        if reached[budget]:
            break
        if weight <= budget:
            fresh = reached[: budget + 1 - weight] & ~reached[weight:]
            by[weight:][fresh] = i
            reached[weight:] |= fresh
    take = np.zeros(len(sizes), np.int64)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        k, n, weight = items[by[at]]
        take[k] += n
        at -= weight
    return take


def plan_counts(by_size: DataFrame) -> DataFrame:
    """by_size(key, size, docs, target) to (key, size, rounds, extra): whole rounds for all, one more copy for `extra` of them."""

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        sizes, counts, target = group["size"].to_numpy(np.int64), group["docs"].to_numpy(np.int64), float(group["target"].iloc[0])
        total = int((sizes * counts).sum())
        rounds = min(int(target // total), MOST_ROUNDS) if total else 0
        extra = fit_budget(sizes, counts, round(target - rounds * total)) if rounds < MOST_ROUNDS else np.zeros(len(sizes), np.int64)
        return pd.DataFrame({"key": group["key"], "size": sizes, "rounds": np.full(len(sizes), rounds, np.int64), "extra": extra})

    return by_size.groupBy("key").applyInPandas(plan, "key string, size bigint, rounds bigint, extra bigint")


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document of docs(doc_id, text, source): size, source_size, target, taken; rows in equal number."""
    sized = docs.select("doc_id", "source", token_count().alias("size"))
    sized = sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size"))
    sized = staged(sized.withColumn("bucket", F.shiftrightunsigned("order", 64 - (BUCKETS.bit_length() - 1)).cast("int")), "sized")
    cells = staged(sized.groupBy("key", "source", "size", "bucket").agg(F.count(F.lit(1)).alias("docs")), "cells")
    by_size = cells.groupBy("key", "source", "size").agg(F.sum("docs").alias("docs"))
    totals = by_size.groupBy("key", "source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"))
    targets = staged(source_targets(totals), "targets")
    planned = plan_counts(by_size.join(targets.select("key", "target"), "key"))
    before = F.coalesce(F.sum("docs").over(W.partitionBy("key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shares = cells.select("key", "size", "bucket", "docs").join(planned, ["key", "size"])
    shares = shares.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("docs"), F.col("extra") - before))).drop("docs")
    shares = shares.join(targets.select("key", "source_size", "target"), "key")
    drawn = sized.join(shares, ["key", "size", "bucket"])
    turn = F.row_number().over(W.partitionBy("key", "size", "bucket").orderBy("order", "doc_id"))
    copies = F.col("rounds") + F.when(turn <= F.col("extra"), 1).otherwise(0)
    return drawn.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.cast("long").alias("copies"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
