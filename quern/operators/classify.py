"""Verdicts on what a configuration changed against its baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of what a configuration did, and of what became of the entities found.
CLASSES = ["UNCHANGED", "HELPED", "HARMED", "EXPECTED_KEPT", "NEITHER"]
TRANSITIONS = ["UNCHANGED", "STREET_INTRODUCED", "STREET_LOST", "STREET_REPLACED", "STREET_EXTENDED", "STREET_NARROWED", "SAME_STREET_KEPT", "NO_STREET_CHANGED"]


def change_class(changed: Column, before: Column, after: Column) -> Column:
    return F.when(~changed, "UNCHANGED").when(~before & after, "HELPED").when(before & ~after, "HARMED").when(before & after, "EXPECTED_KEPT").otherwise("NEITHER")


def tolerant_class(changed: Column, before: Column, after: Column, other: Column, greedy: Column) -> Column:
    """As change_class, but the greedy configuration never counts as changed, and one that lands on another entity does harm."""
    plain = change_class(changed & ~greedy, before, after)
    return F.when((plain == "NEITHER") & other, "HARMED").otherwise(plain)


def transition_class(changed: Column, base: Column, config: Column) -> Column:
    """What happened to the set of entities found; both are arrays of distinct values."""
    added, removed = F.size(F.array_except(config, base)) > 0, F.size(F.array_except(base, config)) > 0
    return (
        F.when(~changed, "UNCHANGED")
        .when(added & (F.size(base) == 0), "STREET_INTRODUCED")
        .when(removed & (F.size(config) == 0), "STREET_LOST")
        .when(added & removed, "STREET_REPLACED")
        .when(added, "STREET_EXTENDED")
        .when(removed, "STREET_NARROWED")
        .when((F.size(base) > 0) & (F.size(config) > 0), "SAME_STREET_KEPT")
        .otherwise("NO_STREET_CHANGED")
    )


def counters(rows: DataFrame, group: list[str], column: str, values: list[str]) -> DataFrame:
    """One counter for each value, in one aggregation."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(column) == v).alias(v.lower()) for v in values])
