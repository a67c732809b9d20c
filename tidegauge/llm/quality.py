"""Quality rules with host-level verdicts.

Every document gets its word and line figures by array expressions in one scan. Rule
failures are aggregated by host (the ``source`` column), each host's failure rate is
shrunk by a beta prior fitted to all hosts by moments, and the host verdicts are joined
back to the documents. A document falls by the base rules, by a gross soft failure, or by
a soft failure beyond what its host is allowed: the host's shrunk rate against the prior's
mean sets that allowance, and a host over the limit has none. A document without any
failure is always kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm._shared import blank_words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.3
MAX_DUP_LINE_SHARE = 0.3
MAX_HOST_RATE = 0.5
#: A soft figure over this many times its limit fails on every host.
GROSS = 2.0

_POSITION_BITS = 20
_LOW = (1 << _POSITION_BITS) - 1


def _window_hash(i: Column) -> Column:
    return F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))


def _same_window(a: Column, b: Column) -> Column:
    return (
        (F.get("words", a) == F.get("words", b))
        & (F.get("words", a + 1) == F.get("words", b + 1))
        & (F.get("words", a + 2) == F.get("words", b + 2))
    )


def _covered(starts: Column) -> Column:
    """Words covered by the three-word windows at sorted distinct ``starts``."""
    gaps = F.transform(
        starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3)).cast("int"))
    )
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


def document_figures(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Repeated windows are found by sorting one long per window, a 44-bit hash over the window's position:
    equal windows become neighbours, and every pair of neighbours is compared word by word. If a
    comparison shows a hash collision, or a text has more than 2^20 words, the text takes the exact
    path, a sort of the windows themselves; so the count is exact for every text.
    """
    text = F.coalesce("text", F.lit(""))
    i0 = F.lit(0)
    base = docs.select(
        *keep,
        blank_words(text).alias("words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0).alias("lines"),
    )
    names = [c for c in base.columns if c not in ("words", "n_symbols", "lines")]
    base = base.select(
        *names,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    figures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    short = (F.col("n_words") >= 3) & (F.col("n_words") <= _LOW)
    packed = F.when(
        short,
        F.transform(
            F.sequence(i0, F.size("words") - 3),
            lambda i: F.shiftleft(F.shiftright(_window_hash(i), _POSITION_BITS), _POSITION_BITS).bitwiseOR(i.cast("long")),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    at = lambda i: F.get("packed", i).bitwiseAND(F.lit(_LOW)).cast("int")
    alike = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("packed") - 1, F.lit(1))),
        lambda i: F.shiftright(F.get("packed", i), _POSITION_BITS) == F.shiftright(F.get("packed", i - 1), _POSITION_BITS),
    )
    base = base.select(*names, "words", *figures, F.sort_array(packed).alias("packed"))
    base = base.select(*names, "words", *figures, "packed", alike.alias("alike"))
    pairs = F.transform("alike", lambda i: F.struct(at(i - 1).alias("a"), at(i).alias("b")))
    base = base.select(*names, "words", *figures, pairs.alias("pairs"))
    clash = (F.col("n_words") > _LOW) | F.exists("pairs", lambda p: ~_same_window(p["a"], p["b"]))
    quick = F.array_sort(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["a"], p["b"])))))
    base = base.select(*names, "words", *figures, clash.alias("clash"), quick.alias("quick"))
    windows = F.array_sort(
        F.transform(
            F.sequence(i0, F.size("words") - 3),
            lambda i: F.struct(F.slice("words", i + 1, 3).alias("w"), i.alias("i")),
        )
    )
    base = base.select(*names, *figures, "clash", "quick", F.when(F.col("clash"), windows).alias("windows"))
    twice = F.array_sort(
        F.transform(
            F.filter(
                F.transform(
                    "windows",
                    lambda w, k: F.struct(
                        w["i"].alias("i"),
                        (
                            F.coalesce(F.get("windows", k - 1)["w"] == w["w"], F.lit(False))
                            | F.coalesce(F.get("windows", k + 1)["w"] == w["w"], F.lit(False))
                        ).alias("twice"),
                    ),
                ),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        )
    )
    base = base.select(*names, *figures, F.when(F.col("clash"), twice).otherwise(F.col("quick")).alias("starts"))
    return base.select(*names, *figures, _covered(F.col("starts")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def soft_failed() -> Column:
    return (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words")) | (
        F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.greatest(F.col("n_lines"), F.lit(1))
    )


def soft_failed_beyond(times: Column) -> Column:
    """The soft rules with their limits taken ``times`` as wide."""
    return (F.col("n_symbols") > times * MAX_SYMBOLS_PER_WORD * F.col("n_words")) | (
        F.col("n_dup_lines") > times * MAX_DUP_LINE_SHARE * F.greatest(F.col("n_lines"), F.lit(1))
    )


def host_verdicts(figures: DataFrame, host: str = "host") -> DataFrame:
    """``host, n_docs, n_failed, rate, host_rejected, allowed``: each host's failure rate shrunk by a beta prior.

    The prior's mean m is the mean and its strength s = m(1-m)/var - 1 comes from the variance of the hosts'
    rates (at least 1; 1e6 if they do not differ). Hosts come pre-aggregated from the map side; a hot host is
    one row per task. ``allowed`` is how many times the soft limits a document of the host may reach: ``GROSS``
    for a host at half the prior's mean or less, halfway between 1 and ``GROSS`` at the mean, nearer to 1 the
    more the host's rate exceeds it, and 1 for a rejected host.
    """
    by_host = figures.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("n_failed")
    )
    prior = by_host.agg(F.avg(F.col("n_failed") / F.col("n_docs")).alias("m"), F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("v")).select(
        "m", F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0))).otherwise(1e6).alias("s")
    )
    rate = (F.col("n_failed") + F.col("m") * F.col("s")) / (F.col("n_docs") + F.col("s"))
    slack = F.when(rate > MAX_HOST_RATE, 0.0).when(rate > 0, F.least(F.lit(1.0), F.col("m") / (2 * rate))).otherwise(1.0)
    return by_host.crossJoin(F.broadcast(prior)).select(
        host,
        "n_docs",
        "n_failed",
        F.round(rate, 9).alias("rate"),
        (rate > MAX_HOST_RATE).alias("host_rejected"),
        F.round(1 + (GROSS - 1) * slack, 9).alias("allowed"),
    )


def assess_documents(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default ``doc_id``), then a struct ``quality`` with the figures and verdicts, one row per
    row of ``docs(doc_id, text, source)``. ``kept`` is the verdict.

    A null text has no word and fails; a null source is a host of its own; without a ``source`` column all rows
    share one host. Columns of ``docs`` may bear any name: they travel in a struct.
    """
    carry = carry or ["doc_id"]
    host = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    figures = document_figures(docs, [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), host.alias("host")])
    staged = written(figures.withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed()), "quality")
    hosts = written(host_verdicts(staged), "hosts")
    # a small host table is broadcast by its measured size, a large one is sort-merged with skew splitting
    judged = staged.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "left")
    kept = ~F.col("base_failed") & ~(F.col("soft_failed") & soft_failed_beyond(F.col("allowed")))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed", "rate", "allowed"]
    verdict = F.struct(*figures, kept.alias("kept"))
    return judged.select("doc", verdict.alias("quality")).select("doc.*", "quality")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they came with."""
    packed = docs.select("doc_id", "text", *(["source"] if "source" in docs.columns else []), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    judged = assess_documents(packed, ["_row"])
    return judged.where("quality.kept").select("_row.*")
