"""Runs by the files they left: which folders are complete, and which is the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def files_under(spark: SparkSession, base: str) -> DataFrame:
    """(run, name, path, size, modified) of all files in folders under base; the run is the first folder below it, the name what follows. Spark's file index lists them; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    root = base.rstrip("/").rpartition("/")[2]
    inner = F.substring_index("path", f"/{root}/", -1)
    rows = rows.withColumn("_inner", inner).where(F.contains("_inner", F.lit("/")))
    return rows.select(F.substring_index("_inner", "/", 1).alias("run"), F.expr("substring(_inner, instr(_inner, '/') + 1)").alias("name"), "path", "size", "modified")


def glob_pattern(glob: str) -> str:
    """A regular expression for a file name pattern with * and ?."""
    return "^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, f"\\Q{c}\\E") for c in glob) + "$"


def complete_runs(files: DataFrame, needed: list[str], barred: Column | None = None) -> DataFrame:
    """(run, files, bytes, modified) of the runs that have a file for each pattern of `needed`; `barred` says of a run's name that it is none."""
    rows = files if barred is None else files.where(~barred)
    has = [F.max(F.rlike("name", F.lit(glob_pattern(g)))).alias(f"_has{k}") for k, g in enumerate(needed)]
    runs = rows.groupBy("run").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("modified").alias("modified"), *has)
    for k in range(len(needed)):
        runs = runs.where(f"_has{k}")
    return runs.select("run", "files", "bytes", "modified")


def newest(runs: DataFrame, by: str = "modified") -> DataFrame:
    """The newest run as one row; by "run" the largest name, as stamps sort as text. Ties go to the larger name."""
    return runs.agg(F.max(F.struct(F.col(by).alias("_by"), "run")).alias("r")).where("r IS NOT NULL").select("r.run").join(runs, "run")


def newest_files(files: DataFrame, needed: list[str], by: str = "modified", barred: Column | None = None) -> DataFrame:
    """All files of the newest complete run."""
    return files.join(F.broadcast(newest(complete_runs(files, needed, barred), by).select("run")), "run", "left_semi")
