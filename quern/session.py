"""A session with the settings that the operators assume."""

from pyspark.sql import SparkSession


def session(cores: int = 8, partitions: int | None = None, memory: str = "8g", **settings: str) -> SparkSession:
    """A local session, with further settings by their names after "spark."; on a cluster use the cluster's own and set UTC and AQE."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config(map={f"spark.{name}": value for name, value in settings.items()})
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
