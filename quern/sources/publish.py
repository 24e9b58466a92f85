"""Results that appear as a whole or not at all: versions behind a pointer, and logs that a repeated batch doesn't grow.

Everything goes through Hadoop's file systems, so targets can lie wherever Spark
writes. A rename of a folder or over a file is one step there; readers see what
was before it or after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

POINTER, LOGGED = "CURRENT", "batch="


def _path(spark: SparkSession, name: str) -> JavaObject:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str) -> JavaObject:
    return _path(spark, name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, name: str, text: str) -> None:
    """A small file, replaced in one step."""
    jvm, fresh = spark.sparkContext._jvm, f"{name}.{uuid.uuid4().hex}"
    out = _files(spark, name).create(_path(spark, fresh))
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, name).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(_path(spark, fresh), _path(spark, name), options)


def _moved(spark: SparkSession, source: str, target: str) -> None:
    if not _files(spark, target).rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"{source} could not become {target}")


def publish(spark: SparkSession, target: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], str | None] | None = None, kind: str = "json", split: dict[str, list[str]] | None = None) -> str:
    """Writes all tables as one new version of `target` and gives its folder.

    First phase: every table goes into a staging folder, partitioned by its
    columns in `split`, is read back and counted against what was written, and
    `check` may name a reason against them. Second phase: the folder is renamed
    to a version and the pointer is replaced. Whatever fails before that leaves
    the last version in force and nothing visible of this one.
    """
    stamp = uuid.uuid4().hex
    staging = f"{target.rstrip('/')}/_staging-{stamp}"
    try:
        back, sizes = {}, {}
        for name, df in tables.items():
            counted = Observation()
            writer = df.observe(counted, F.count(F.lit(1)).alias("n")).write
            (writer.partitionBy(*split[name]) if split and name in split else writer).format(kind).save(f"{staging}/{name}")
            back[name] = spark.read.schema(df.schema).format(kind).load(f"{staging}/{name}")
            sizes[name] = back[name].count()
            if sizes[name] != counted.get["n"]:
                raise OSError(f"{name}: {sizes[name]} rows on disk of {counted.get['n']}")
        wrong = check(back) if check else None
        if wrong:
            raise ValueError(wrong)
        _moved(spark, staging, f"{target.rstrip('/')}/v-{stamp}")
    except BaseException:
        _files(spark, staging).delete(_path(spark, staging), True)
        raise
    _write_text(spark, f"{target.rstrip('/')}/{POINTER}", json.dumps({"version": f"v-{stamp}", "rows": sizes}, sort_keys=True))
    return f"{target.rstrip('/')}/v-{stamp}"


def current_version(spark: SparkSession, target: str) -> dict | None:
    """What the pointer says: the version's name and its tables' rows; None where nothing was published."""
    pointer = f"{target.rstrip('/')}/{POINTER}"
    if not _files(spark, pointer).exists(_path(spark, pointer)):
        return None
    return json.loads(spark.read.text(pointer, wholetext=True).first().value)


def published(spark: SparkSession, target: str, name: str, schema: str | None = None, kind: str = "json") -> DataFrame:
    """A table of the version in force."""
    version = current_version(spark, target)
    if version is None:
        raise FileNotFoundError(target)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(kind).load(f"{target.rstrip('/')}/{version['version']}/{name}")


def export_splits(plan: DataFrame, verified: DataFrame, target: str, key: str = "id", columns: tuple[str, ...] = ("audio", "text")) -> str:
    """The manifests of a plan's splits as one version; ValueError where a planned row has no verified artifact, or a split on disk hasn't the plan's number of rows."""
    spark = plan.sparkSession
    if not plan.join(verified.select(key), key, "left_anti").isEmpty():
        raise ValueError("plan rows without a verified artifact")
    wanted = plan.groupBy("split").agg(F.count(F.lit(1)).alias("n"))

    def check(back: dict[str, DataFrame]) -> str | None:
        found = back["manifests"].groupBy("split").agg(F.count(F.lit(1)).alias("m"))
        off = wanted.join(found, "split", "full_outer").where(~F.col("n").eqNullSafe(F.col("m"))).limit(5).collect()
        return f"splits with other than their rows: {', '.join(f'{r.split} {r.m} for {r.n}' for r in off)}" if off else None

    return publish(spark, target, {"manifests": plan.select(*columns, "split")}, check, split={"manifests": ["split"]})


def append_once(batch: DataFrame, log: str, number: int | str) -> bool:
    """Adds a batch to a log of JSON lines under its number; False where the log has that number already.

    The batch is written beside its place and renamed there, so its folder is
    the ledger's entry: it is there as a whole or not at all, and a batch that
    is replayed after a failure leaves the same files.
    """
    spark, place = batch.sparkSession, f"{log.rstrip('/')}/{LOGGED}{number}"
    if _files(spark, place).exists(_path(spark, place)):
        return False
    staging = f"{log.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    try:
        batch.write.json(staging)
        _moved(spark, staging, place)
    except BaseException:
        _files(spark, staging).delete(_path(spark, staging), True)
        raise
    return True


def append_stream(rows: DataFrame, log: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream into a log, each micro-batch once."""
    return rows.writeStream.foreachBatch(lambda batch, number: append_once(batch, log, number) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def log_rows(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """All rows of a log with the number of their batch."""
    return spark.read.schema(f"{schema}, batch bigint").json(log)


def snapshot(rows: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The last record of each key."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(last).select("r.*")
