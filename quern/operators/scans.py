"""Line and record scans that report what they reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line) of each text; null texts have no lines."""
    return texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def audit_lines(lines: DataFrame, key: str, heading: str, allowed: str) -> DataFrame:
    """Adds `reason`: why a line is no entry; null where it is one. The first of equal lines under a key counts."""
    s = F.trim("line")
    order = W.partitionBy(key, F.xxhash64(s), s).orderBy("line_no")
    reason = F.when(s == "", "empty line").when(F.rlike(s, F.lit(heading)), "page heading").when(~F.rlike(s, F.lit(allowed)), "invalid characters").when(F.row_number().over(order) > 1, "duplicate")
    return lines.withColumn("reason", reason)


def first_wins(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key.

    A struct minimum rather than a window: equal keys are reduced before the
    shuffle, so a key with a third of all rows costs a row a task.
    """
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)])
    picked = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(named)]).agg(F.min_by(F.struct(*df.columns), rank).alias("row"))
    return picked.select("row.*")


def json_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds `parsed`, and `bad` where the JSON can't be read as an object."""
    parsed = F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return df.withColumn("parsed", parsed).withColumn("bad", F.col("parsed").isNull() | F.col("parsed._bad").isNotNull())


def saved_records(df: DataFrame, where: Column, order: list[str], limit: int | None) -> DataFrame:
    """Records that meet a condition, in manifest order; the top-k form of sort and limit."""
    out = df.where(where).orderBy(*order)
    return out.limit(limit) if limit is not None else out


def latest_by(df: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    rank = F.struct(*order)
    return df.groupBy(key).agg(*[F.max_by(c, rank).alias(c) for c in columns])
