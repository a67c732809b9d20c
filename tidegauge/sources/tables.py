"""Readers and writers by suffix, stream and sample loaders, configuration files.

Excel has no reader in Spark; ``read_sheets`` takes one file per sheet, and ``READERS`` may be extended.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.text import match_headers, numeric
from tidegauge.functions.timeline import MINUTE, micros
from tidegauge.operators.asof import lagged_snapshots

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": lambda s, p: s.read.csv(p, header=True),
    "parquet": lambda s, p: s.read.parquet(p),
    "pq": lambda s, p: s.read.parquet(p),
    "json": lambda s, p: s.read.json(p),
    "orc": lambda s, p: s.read.orc(p),
}
WRITERS = {"csv": lambda w, p: w.option("header", True).csv(p), "parquet": lambda w, p: w.parquet(p), "json": lambda w, p: w.json(p), "orc": lambda w, p: w.orc(p)}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix; an unknown suffix is an error."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for .{suffix}: {path}")
    return READERS[suffix](spark, path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in WRITERS:
        raise ValueError(f"no writer for .{suffix}: {path}")
    WRITERS[suffix](df.write.mode(mode), path)


def read_stream_csv(spark: SparkSession, path: str, time: str = "time") -> DataFrame:
    """Wide sensor CSV: a time column is required, all others become DOUBLE or NULL, rows without a time go."""
    raw = spark.read.csv(path, header=True)
    if time not in raw.columns:
        raise ValueError(f"{path} has no column {time}")
    cast = [numeric(F.col(f"`{c}`")).alias(c) for c in raw.columns if c != time]
    return raw.select(F.try_to_timestamp(F.col(time)).alias(time), *cast).where(F.col(time).isNotNull())


def read_mapped_stream(spark: SparkSession, path: str, sensors: Sequence[str], time: str = "time") -> DataFrame:
    """Only the wanted sensors, by normalised header, in the given order; those the file lacks are NULL."""
    raw = read_table(spark, path)
    found = match_headers(raw.columns, {time: [], **{s: [] for s in sensors}})
    if time not in found:
        raise ValueError(f"{path} has no time column")
    cols = [numeric(F.col(f"`{found[s]}`")).alias(s) if s in found else F.lit(None).cast("double").alias(s) for s in sensors]
    return raw.select(F.col(f"`{found[time]}`").cast("string").try_cast("timestamp").alias(time), *cols).where(F.col(time).isNotNull())


def read_sheets(spark: SparkSession, sheets: Mapping[str, str]) -> DataFrame:
    """Union by name of one file per sheet, tagged ``source_sheet``; ``ord`` keeps the order of the sheets."""
    out = None
    for i, (sheet, path) in enumerate(sheets.items()):
        part = read_table(spark, path).withColumns({"source_sheet": F.lit(sheet), "sheet_ord": F.lit(i)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


SAMPLE_RULES = {"sample_time": ["time", "date"], "target": ["result", "value"], "sample_name": ["name", "point"]}


def read_samples(spark: SparkSession, sheets: Mapping[str, str], rules: Mapping[str, list[str]] = SAMPLE_RULES) -> DataFrame:
    raw = read_sheets(spark, sheets)
    found = match_headers([c for c in raw.columns if c not in ("source_sheet", "sheet_ord")], dict(rules))
    if "sample_time" not in found:
        raise ValueError("no sample time column")
    cols = [F.col(f"`{c}`").cast("string").try_cast("timestamp").alias(k) if k == "sample_time" else (numeric(F.col(f"`{c}`")).alias(k) if k == "target" else F.col(f"`{c}`").alias(k)) for k, c in found.items()]
    return raw.select(*cols, "source_sheet", "sheet_ord").where("sample_time is not null")


def load_casebase(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    """A feature table with canonical names, complete in time and target, with ``is_in_spec``. Without times, rows are numbered by
    minutes from the epoch in file order."""
    raw = read_table(spark, path)
    found = match_headers(raw.columns, {"sample_time": ["time"], "target": []})
    df = raw.withColumnsRenamed({v: k for k, v in found.items()})
    if "target" not in df.columns:
        raise ValueError("a case base needs a target column")
    if "sample_time" not in df.columns:
        df = df.withColumn("sample_time", F.timestamp_micros(F.monotonically_increasing_id() * MINUTE))
    df = df.withColumns({"sample_time": F.col("sample_time").cast("timestamp"), "target": numeric(F.col("target"))})
    return df.na.drop(subset=["sample_time", "target"]).withColumn("is_in_spec", F.col("target").between(low, high).cast("int"))


def infer_channel(df: DataFrame) -> DataFrame:
    """``time, value`` of a single-channel history: by known names, by substring, or by probing which column parses as time or
    number in at least a third of the rows (one aggregate job)."""
    found = match_headers(df.columns, {"time": ["timestamp", "col2"], "value": ["ph", "col3"]})
    if len(found) < 2:
        probe = df.agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.count(F.col(f"`{c}`").cast("string").try_cast("timestamp")).alias(f"t{i}") for i, c in enumerate(df.columns)],
            *[F.count(numeric(F.col(f"`{c}`"))).alias(f"v{i}") for i, c in enumerate(df.columns)],
        ).first()
        third = max(5, probe["_n"] / 3)
        times = [c for i, c in enumerate(df.columns) if probe[f"t{i}"] >= third and probe[f"v{i}"] < third]
        values = [c for i, c in enumerate(df.columns) if probe[f"v{i}"] >= third]
        if not times or not values:
            raise ValueError("no time and value columns")
        found = {"time": found.get("time", times[0]), "value": found.get("value", values[0])}
    time = F.col(f"`{found['time']}`").cast("string").try_cast("timestamp")
    return df.select(time.alias("time"), numeric(F.col(f"`{found['value']}`")).alias("value")).na.drop()


def positional(df: DataFrame, time: str, first: int, last: int, blocked: Sequence[str] = ()) -> DataFrame:
    """Columns ``first``..``last`` (from 1, inclusive) as DOUBLE, without those that hold a blocked text, and the time column."""
    names = [c for c in df.columns[first - 1 : last] if c != time and not any(b in c for b in blocked)]
    return df.select(F.col(time).cast("timestamp").alias(time), *[F.col(f"`{c}`").cast("double").alias(c) for c in names])


def audit_layout(columns: Sequence[str]) -> tuple[str, list[str], str]:
    """Positional roles: the first column is the time, columns 8 to the last but one are features, the last is the target."""
    if len(columns) < 9:
        raise ValueError("at least nine columns are needed")
    return columns[0], list(columns[7:-1]), columns[-1]


def load_parts(spark: SparkSession, manifest: Mapping, samples: DataFrame, lag_minutes: int, tolerance_minutes: int) -> DataFrame:
    """Multi-part features: each part of the manifest (``{"parts": [{"path", "columns"}]}``) gives as-of snapshots by sample."""
    out = samples
    for part in manifest["parts"]:
        values = read_table(spark, part["path"])
        out = lagged_snapshots(out, values.select("t", *part["columns"]), part["columns"], [lag_minutes], tolerance_minutes).drop("available")
    return out


def load_config(path: str, required: Sequence[str] = ()) -> dict:
    """A YAML or JSON mapping from the driver's file system, with its required keys checked."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(f)
        else:
            data = json.load(f)
    if not isinstance(data, dict):
        raise ValueError(f"{path} is not a mapping")
    if missing := [k for k in required if k not in data]:
        raise ValueError(f"{path} lacks {missing}")
    return data


def point_notes(spark: SparkSession, path: str) -> DataFrame:
    """``tag, note`` of a points table."""
    raw = read_table(spark, path)
    found = match_headers(raw.columns, {"tag": ["point"], "note": ["description", "comment"]})
    return raw.select(F.trim(F.col(f"`{found['tag']}`")).alias("tag"), F.col(f"`{found['note']}`").alias("note"))


def synthetic_window(spark: SparkSession, stats: Mapping[str, Mapping[str, float]], minutes: int, end: str) -> DataFrame:
    """A window rebuilt from summary statistics: last + slope x offset, or linear from the delta where no slope is known."""
    base = spark.range(minutes + 1).select((F.col("id") - minutes).alias("offset"))
    at = F.timestamp_add("MINUTE", F.col("offset").cast("int"), F.lit(end).cast("timestamp"))
    cols = [(F.lit(float(s["last"])) + F.lit(float(s["slope"] if "slope" in s else s.get("delta", 0.0) / max(minutes, 1))) * F.col("offset")).alias(n) for n, s in stats.items()]
    return base.select(at.alias("time"), *cols)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON documents; NaN and infinity become null."""
    clean = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("document"))


def event_stream(df: DataFrame) -> DataFrame:
    """The driver's events as a long sensor stream ``event_id, sensor, unit, t, value``."""
    return df.select("event_id", F.col("event_type").alias("sensor"), F.col("user_id").alias("unit"), micros("ts").alias("t"), "value")
