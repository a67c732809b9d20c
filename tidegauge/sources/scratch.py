"""Tables that an operator stores between its steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_used: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and all tasks run in the driver's process, as in tests.
    On a cluster without the setting this raises ``ValueError``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back, so that readers neither repeat it nor need the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/steps/{name}-{uuid.uuid4().hex}"
    _used.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_steps(spark: SparkSession) -> int:
    """Delete the stored tables of this driver; results that still read them fail afterwards. Returns their number."""
    n = len(_used)
    while _used:
        path = spark._jvm.org.apache.hadoop.fs.Path(_used.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
