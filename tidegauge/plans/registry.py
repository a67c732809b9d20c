"""All registered queries of the engine's own operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.tables import event_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6
#: Means of short decimals over 32 or 64 rows are exact halves in the seventh digit; the nudge takes them off the boundary.
NUDGE = 3.1e-8

#: Events as samples (purchases) and as a sensor stream (all other types).
EVENTS_SQL = """WITH e AS (SELECT event_id, event_type AS sensor, user_id AS unit, epoch_us(ts) AS t, value FROM events),
s AS (SELECT event_id AS sample_id, unit, t, value FROM e WHERE sensor = 'purchase'),
r AS (SELECT * FROM e WHERE sensor <> 'purchase')"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits: sums of floats depend on the order of the rows."""
    return df.select(*[(F.round(F.col(c) + F.lit(NUDGE), DIGITS) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = ""):
    """Registers a query under its function's name; ``doubles`` names the columns that the SQL side rounds too."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            swap = ", ".join(f"round({c} + {NUDGE:.2e}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            ORACLE[f.__name__] = f"SELECT *{f' REPLACE ({swap})' if swap else ''} FROM (\n{sql}\n)"
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(read(spark, sf_dir, "events"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("sensor = 'purchase'").select(F.col("event_id").alias("sample_id"), "unit", "t", "value")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("sensor <> 'purchase'")


from tidegauge.plans import slices_series, summaries, decisions, learning  # noqa: E402, F401, I001
