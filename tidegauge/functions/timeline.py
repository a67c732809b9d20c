"""Time as microseconds (BIGINT), and the buckets that let ordered work run in parallel without a key.

A global ``ORDER BY time`` window moves every row to one task. Whatever looks back at most ``width`` only needs the
rows of its own bucket of that width and of the one before, so rows are dealt to buckets with a copy for the
neighbour, and every window partitions by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def bucket(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(width)).cast("long")


def halo(df: DataFrame, t: str, width: int, before: bool = True, after: bool = False) -> DataFrame:
    """``df`` with ``_bucket`` and ``_own``: every row in its own bucket, and copies (``_own`` false) for the next bucket
    (``before``: others look back at it) and the previous one (``after``)."""
    shifts = [0] + [1] * before + [-1] * after
    return df.withColumn("_shift", F.explode(F.array(*map(F.lit, shifts)))).select(
        *df.columns, (bucket(F.col(t), width) + F.col("_shift")).alias("_bucket"), (F.col("_shift") == 0).alias("_own")
    )


def carried_fold(df: DataFrame, by: list[str], columns: list[str], width: int, summarise, carry, start, fold, out: str) -> DataFrame:
    """A fold over each key's rows in order of ``t, event_id`` that never holds more than ``width`` micros of a key.

    Pieces of ``width`` are summarised on their own (``summarise(frame) -> list of floats``), the state before each piece follows
    from the summaries of those before it (``carry(state, summary) -> state``, a float or None, from ``start``; one small row a
    piece), and every piece is folded from its own state (``fold(frame, state) -> values``). Returns ``by, event_id, t, columns`` and the
    values as the double ``out``. Rows without a time come last.
    """
    import pandas as pd
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    rows = df.select(*by, "event_id", "t", *columns).withColumn("_piece", bucket(F.col("t"), width))
    own = [rows.schema[c] for c in [*by, "_piece"]]
    order = ["t", "event_id"]

    def summary(g: pd.DataFrame) -> pd.DataFrame:
        head = g[[*by, "_piece"]].head(1)
        return head.assign(_s=[summarise(g.sort_values(order))])

    def states(g: pd.DataFrame) -> pd.DataFrame:
        g, state, before = g.sort_values("_piece"), start, []
        for s in g["_s"]:
            before.append(state)
            state = carry(state, s)
        return g[[*by, "_piece"]].assign(_state=pd.Series(before, index=g.index, dtype="float64"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        state = g["_state"].iloc[0]
        values = fold(g, None if state != state or state is None else float(state))
        return g.drop(columns=["_piece", "_state"]).assign(**{out: pd.Series(values, index=g.index, dtype="float64")})

    parts = rows.groupBy(*by, "_piece").applyInPandas(summary, StructType([*own, StructField("_s", ArrayType(DoubleType()))]))
    known = parts.groupBy(*by).applyInPandas(states, StructType([*own, StructField("_state", DoubleType())]))
    known = known.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_piece"]], "_state")
    same = F.lit(True)
    for c in [*by, "_piece"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    held = rows.join(known, same, "left").select(*rows.columns, "_state")
    fields = [f for f in rows.schema.fields if f.name != "_piece"]
    return held.groupBy(*by, "_piece").applyInPandas(run, StructType([*fields, StructField(out, DoubleType())]))
