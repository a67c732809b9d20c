"""Scratch tables, text tokens and row keys that several operators use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named and all tasks run in the
    driver's process, as in tests. On a cluster without the setting this raises ``ValueError``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_used: list[str] = []


def scratch_path(spark: SparkSession, kind: str, name: str) -> str:
    """A new path in the scratch folder; ``clear_scratch`` deletes what was handed out."""
    _used.append(f"{scratch_dir(spark)}/{kind}/{name}-{uuid.uuid4().hex}")
    return _used[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables and archives that this driver wrote to the scratch folder; results that still read them fail
    afterwards. Returns their number."""
    n = len(_used)
    while _used:
        path = spark._jvm.org.apache.hadoop.fs.Path(_used.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the scratch folder and read back: later readers neither
    compute it again nor depend on the executors that made it.

    With ``batch_rows`` the write hands its Python workers so many rows at a time, where the session has Spark's default of
    10,000: whole texts are long, and a task holds its batch several times. The setting is put back when the write ends."""
    conf = df.sparkSession.conf
    path = scratch_path(df.sparkSession, "tables", name)
    lowered = batch_rows is not None and conf.get(_BATCH_ROWS) == "10000"
    if lowered:
        conf.set(_BATCH_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        if lowered:
            conf.set(_BATCH_ROWS, "10000")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the scratch folder, for small relations in loops."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of whole texts that a Python worker is handed at a time.
TEXT_ROWS = 1000
#: Bytes of rows that a broadcast may have.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored ``df``, marked for broadcast if its counted rows of about ``row_bytes`` stay below ``BROADCAST_BYTES``;
    else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, and no other letter."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text without nulls; no word gives an empty array."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
