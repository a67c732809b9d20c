"""Streaming forms of the batch operators: the same results with an ``availableNow`` trigger on a bounded source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.operators.runs import NORMAL, next_state


def tumbling_last(stream: DataFrame, step: str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    """Last value per step and key; rows later than ``delay`` behind the newest are dropped by the watermark."""
    return stream.withWatermark("time", delay).groupBy(F.window("time", step), *by).agg(F.max_by("value", F.struct("time", "event_id")).alias("value")).select(*by, F.col("window.start").alias("start"), "value")


def sliding_stats(stream: DataFrame, width: str, slide: str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("time", delay).groupBy(F.window("time", width, slide), *by).agg(F.count("value").alias("n"), F.avg("value").alias("mean")).select(*by, F.col("window.start").alias("start"), "n", "mean")


def sessions(stream: DataFrame, gap: str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    """Stretches of rows per key without a pause of ``gap``: start, end and rows."""
    return stream.withWatermark("time", delay).groupBy(F.session_window("time", gap), *by).agg(F.count(F.lit(1)).alias("rows")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "rows")


def hysteresis_stream(stream: DataFrame, key: str, warn: float, alarm: float, warn_release: float = 0.80, alarm_release: float = 0.85) -> DataFrame:
    """Two-level hysteresis with one integer of state per key; a batch's rows of a key are taken in time order."""
    import pandas as pd

    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get[0] if state.exists else NORMAL
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        out = []
        for p in rows["score"]:
            current = next_state(current, p, warn, alarm, warn_release, alarm_release)
            out.append(current)
        state.update((current,))
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"].to_numpy(), "state": out})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, state int", "state int", "append", GroupStateTimeout.NoTimeout)


def delayed_outcomes(queries: DataFrame, outcomes: DataFrame, delay: str, within: str) -> DataFrame:
    """Stream-stream join: outcomes of the same key that are known ``delay`` before a query and at most ``within`` old; both
    watermarks let Spark drop state."""
    q = queries.withWatermark("query_time", delay).alias("q")
    o = outcomes.withWatermark("outcome_time", delay).alias("o")
    known = F.expr(f"o.key = q.key AND o.outcome_time <= q.query_time - INTERVAL {delay} AND o.outcome_time >= q.query_time - INTERVAL {delay} - INTERVAL {within}")
    return q.join(o, known).select("q.query_id", "o.outcome_id", "o.y")


def append_library(stream: DataFrame, path: str, checkpoint: str):
    """A growing label library: every micro-batch is appended to a table, once per batch id, for the batch retrieval to read."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def file_stream(spark, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Continuous ingestion of files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def in_order(spark, path: str, last: str, batch_bytes: int) -> int:
    """Moves the file of the folder ``last`` behind the files of ``path`` and dates all of them in order of their names:
    a file stream takes files by their time of change, and tasks end in any order. Returns how many files fill a batch."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = lambda folder: sorted(f.getPath().toString() for f in fs.listStatus(Path(folder)) if f.getPath().getName().startswith("part-"))
    for i, name in enumerate(parts(last)):
        fs.rename(Path(name), Path(f"{path}/part-z{i}.parquet"))
    names = parts(path)
    newest = max((f.getModificationTime() for f in fs.listStatus(Path(path))), default=0)
    for i, name in enumerate(names):
        at = newest + 1000 * (i - len(names))
        fs.setTimes(Path(name), at, at)
        if fs.getFileStatus(Path(name)).getModificationTime() != at:
            raise OSError(f"{path}: the store keeps no times of change, so its files cannot be streamed in order")
    return max(1, len(names) * batch_bytes // max(1, fs.getContentSummary(Path(path)).getLength()))
