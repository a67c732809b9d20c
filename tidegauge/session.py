"""A session with the settings that the operators assume."""

from pyspark.sql import SparkSession


def session(name: str = "tidegauge", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew splitting; ``conf`` adds to or overrides it (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
