"""Deterministic corpus plans: candidates, hashed orders and splits, quotas, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions import numbers
from quern.operators.positions import positional_within
from quern.scratch import staged

#: Templates with their prefixes and tails that are broadcast at most.
BROADCAST_BANK = 100_000


def candidates(entities: DataFrame, bank: DataFrame, prefixes: list[str], tails: list[str], most_words: int, barred: Column | None = None) -> DataFrame:
    """entities x bank(template, family) x prefixes x tails, with `{name}` filled in.

    Templates of at most two words stay bare; `barred` says which combinations
    contradict themselves. The product is the operator: each entity with each
    template of a bank that is counted first; a larger one is dealt out by entity.
    """
    long = F.size(F.split("template", " ")) > 2
    options = lambda values: F.explode(F.when(long, F.array(*map(F.lit, values))).otherwise(F.array(F.lit(""))))
    wide = bank.withColumn("prefix", options(prefixes)).withColumn("tail", options(tails))
    if barred is not None:
        wide = wide.where(~barred)
    body = F.replace(F.col("template"), F.lit("{name}"), F.col("name"))
    text = F.array_join(F.filter(F.array("prefix", body, "tail"), lambda x: x != ""), ", ")
    wide = F.broadcast(wide) if wide.count() <= BROADCAST_BANK else wide
    return entities.crossJoin(wide).withColumn("text", text).where(F.size(F.split("text", r"[ ]+")) <= most_words)


def choices(rows: DataFrame, quota: Column, order: list[Column | str], capped: Column, cap: Column, group: list[str], unique: str) -> DataFrame:
    """What each group takes of its rows, with `rank`: in order up to its quota, at most `cap` of the capped ones, and no text twice.

    A text that a group has both as a capped and as another row is taken by
    whichever comes first; the other one serves where the cap is reached. A
    group's candidates are ordered in one task, the groups in parallel.
    """
    own = W.partitionBy(*group)
    ordered = own.orderBy(*order)
    first = rows.withColumn("_copy", F.row_number().over(W.partitionBy(*group, unique, capped).orderBy(*order))).where("_copy = 1")
    alone = first.withColumn("_before", F.max(~capped).over(W.partitionBy(*group, unique).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))).where(~(capped & F.coalesce("_before", F.lit(False))))
    counted = alone.withColumn("_kind", F.row_number().over(W.partitionBy(*group, capped).orderBy(*order))).where(~capped | (F.col("_kind") <= cap))
    taken = counted.withColumn("_taken", F.max(capped).over(W.partitionBy(*group, unique))).where(capped | ~F.col("_taken"))
    ranked = taken.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= quota)
    return ranked.drop("_copy", "_before", "_kind", "_taken")


def select_quota(rows: DataFrame, group: list[str], quota: Column, order: list[Column | str], capped: Column, cap: Column, unique: str = "text") -> DataFrame:
    """Rows as a planner takes them that serves one group after another, in the order of `group`: each takes what choices() says of the texts that no earlier group has taken.

    Groups propose in rounds instead. All at once they ask for their choice; a
    text asked for goes to its earliest group, and later ones lose it and may ask
    for their next in the following round. As all texts prefer the earlier group,
    and a group never gives up what it still may have, this ends, when no group
    loses a row, at the one plan that the serial planner makes. Only groups with
    texts that another group has, too, take part in rounds; their rows are staged
    from round to round.
    """
    key = F.struct(*group)
    owners = rows.groupBy(unique).agg(F.min(key).alias("_a"), F.max(key).alias("_b")).where("_a < _b").select(unique)
    groups = staged(rows.join(owners, unique, "left_semi").select(*group).distinct(), "contested-groups")
    choose = lambda live: choices(live, quota, order, capped, cap, group, unique)
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    free = choose(rows.alias("l").join(groups.alias("r"), same, "left_anti"))
    if groups.isEmpty():
        return free
    live = staged(rows.alias("l").join(groups.alias("r"), same, "left_semi"), "candidates")
    left = live.count()
    while True:
        asked = choose(live).groupBy(F.col(unique).alias("_text")).agg(F.min(key).alias("_holder"))
        kept = live.join(asked, F.col(unique) == F.col("_text"), "left").where(F.col("_holder").isNull() | (key <= F.col("_holder")))
        live = staged(kept.drop("_text", "_holder"), "candidates")
        before, left = left, live.count()
        if left == before:
            return free.unionByName(choose(live))


def unmet(selected: DataFrame, groups: DataFrame, group: list[str], quota: Column) -> DataFrame:
    """(group, found, quota) of the groups that have other than their quota of selected rows."""
    found = selected.groupBy(*group).agg(F.count(F.lit(1)).alias("found"))
    return groups.select(*group).distinct().join(found, group, "left").fillna(0, ["found"]).withColumn("quota", quota).where("found <> quota")


def require_quota(selected: DataFrame, groups: DataFrame, group: list[str], quota: Column) -> DataFrame:
    """selected, if every group has its quota; else ValueError naming some that haven't."""
    short = unmet(selected, groups, group, quota).limit(5).collect()
    if short:
        raise ValueError("too few distinct texts: " + "; ".join(" ".join(map(str, r)) for r in short))
    return selected


def cross_group_texts(rows: DataFrame, group: list[str], unique: str = "text") -> DataFrame:
    return rows.groupBy(unique).agg(F.count_distinct(F.struct(*group)).alias("groups")).where("groups > 1")


def round_robin(rows: DataFrame, start: Column, group: str, order: str, values: list[str]) -> DataFrame:
    """Adds each row's `turn` in its group and the `voice` that is next, from `start` on; a group may be of any size."""
    turns = positional_within(rows, [group], [order], "turn").withColumn("turn", F.col("turn").cast("int"))
    return turns.withColumn("voice", F.element_at(F.array(*map(F.lit, values)), (F.pmod(start + F.col("turn") - 1, F.lit(len(values))) + 1).cast("int")))


def hash_split(rows: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """train, validation and test within each group, in the order of hashes; the holdouts have equal size.

    Only ranks up to twice the holdout matter: they are found from counts of
    hash prefixes, so the ordering window sees a few rows of each group.
    """
    hashed = rows.withColumn("hash", numbers.sha(F.lit(seed), key)).withColumn("cell", numbers.hex_number(F.col("hash"), 1, 3))
    cells = hashed.groupBy(group, "cell").agg(F.count(F.lit(1)).alias("c"))
    sums = cells.withColumn("before", F.coalesce(F.sum("c").over(W.partitionBy(group).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(W.partitionBy(group)))
    joined = hashed.join(sums.select(F.col(group).alias("_g"), F.col("cell").alias("_cell"), "before", "n"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("cell") == F.col("_cell")))
    rank = F.col("before") + F.row_number().over(W.partitionBy(group, "cell").orderBy("hash", key))
    held = numbers.holdout_size(F.col("n"))
    split = F.when(F.col("n") < 2, "train").when(rank <= held, "test").when((rank <= 2 * held) & (F.col("n") > 2), "validation").otherwise("train")
    return joined.withColumn("split", split).drop("hash", "cell", "before", "_g", "_cell")
