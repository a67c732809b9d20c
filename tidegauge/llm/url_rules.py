"""URL filter: a sort-merge range join of URLs with nested host and path rules.

A host becomes a canonical key, its labels reversed and each closed by a dot
(``www.example.org`` -> ``org.example.www.``), so that a rule's host and all its
subdomains are one interval of keys. URLs and rule keys are dealt to buckets,
sorted by key and swept once: the window carries the rule node opened last, and
every node holds the stack of hosts with rules that enclose it. Intervals nest, so
what is active at a URL is the part of that stack that has not closed yet.

The path rules of one host are intervals of paths, nested in the same way: for each
level of the stack the URLs are sorted by (host of that level, path) among the rules
of that host and swept again, with the stack of the rules whose paths are prefixes
of the path opened last. So a host's rules are rows, never one array, and a stack
is no longer than a path.

Each bucket gets all rules and at least four times as many URLs, so the copies of
the rules stay below a quarter of the input whatever the number of rules, and a
hot host is spread over all buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm._shared import ascii_lower

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
MIN_BUCKET_ROWS = 100_000
_BEST = "struct<size: int, hosts: int, rule: string, verdict: string>"


def url_host(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def url_path(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    tail = F.substr(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + 1)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(tail, r"^[^?#]*", 0)).otherwise("")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _nodes(rules: DataFrame) -> DataFrame:
    """``key, stack``: one row per rule host, its key and all enclosing hosts with rules, its own included."""
    own = rules.select("host", host_key(F.col("host")).alias("key")).distinct()
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    chain = own.select(
        F.col("key").alias("at"),
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
        ).alias("key"),
    )
    return chain.join(own, "key").groupBy(F.col("at").alias("key")).agg(F.array_sort(F.collect_set("host")).alias("stack"))


def _chains(rules: DataFrame) -> DataFrame:
    """``at, path, chain``: one row per host and path of a rule, with the rules of that host whose paths are prefixes."""
    own = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    prefix = F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n)))
    longer = own.select("host", F.col("path").alias("whole"), prefix.alias("path"))
    return (
        longer.join(own, ["host", "path"])
        .groupBy(F.col("host").alias("at"), F.col("whole").alias("path"))
        .agg(F.collect_list(F.struct("path", "verdict")).alias("chain"))
    )


def _sweep(points: DataFrame, opened: DataFrame, carried: str, order: list[str], n_buckets: int) -> DataFrame:
    """Each of ``points`` with the column ``carried`` of the row of ``opened`` that comes last before it in ``order``."""
    everywhere = opened.select(F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))).alias("bucket"), "*", F.lit(0).alias("kind"))
    before = Window.partitionBy("bucket").orderBy(*order, "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = points.withColumn("kind", F.lit(1)).unionByName(everywhere, allowMissingColumns=True)
    return both.withColumn(carried, F.last(carried, ignorenulls=True).over(before)).where("kind = 1").drop("kind")


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url)``; other columns are not read.

    Null URLs and URLs without ``://`` have an empty host and path and get ``default`` with a null rule.
    Of the rules that fit, the longest (host and path together) wins; of equally long ones the longest
    host, then the alphabetically first, then ``allow`` before ``block``. Repeated rows are judged one by
    one; an empty table gives an empty result, and without rules all get ``default``.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    rules = rules.select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where("host is not null and verdict is not null")
    nodes, chains = _nodes(rules), _chains(rules).select("at", "path", F.struct("at", "chain").alias("top"))
    n_rules = rules.count()
    levels = nodes.agg(F.max(F.size("stack"))).first()[0] or 0
    n_buckets = max(1, math.ceil(pages.select("page_id").count() / max(MIN_BUCKET_ROWS, 4 * n_rules)))
    n_buckets = max(n_buckets, min(spark.sparkContext.defaultParallelism, 64) if n_rules <= 4096 else 1)

    points = (
        pages.select("page_id", F.col("url").alias("url"))
        .select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        .select(
            "page_id",
            F.coalesce("host", F.lit("")).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            F.pmod(F.xxhash64("page_id", "url"), F.lit(n_buckets)).cast("int").alias("bucket"),
        )
        .select("bucket", host_key(F.col("host")).alias("key"), "page_id", "host", "path")
    )
    fit = F.filter("stack", lambda h: (F.col("host") == h) | F.endswith(F.col("host"), F.concat(F.lit("."), h)))
    judged = _sweep(points, nodes, "stack", ["key"], n_buckets).select(
        "bucket", "page_id", "host", "path", fit.alias("hosts"), F.lit(None).cast(_BEST).alias("best")
    )
    for level in range(levels):
        points = judged.withColumn("at", F.get("hosts", F.lit(level)))
        fits = F.filter("top.chain", lambda r: (F.col("top.at") == F.col("at")) & F.startswith(F.col("path"), r["path"]))
        # the smallest of (-length, -host length, text, verdict) is the longest rule
        best = F.array_min(
            F.transform(
                fits,
                lambda r: F.struct(
                    (-(F.length("at") + F.length(r["path"]))).alias("size"),
                    (-F.length("at")).alias("hosts"),
                    F.concat("at", r["path"]).alias("rule"),
                    r["verdict"].alias("verdict"),
                ),
            )
        )
        judged = _sweep(points, chains, "top", ["at", "path"], n_buckets).select(
            "bucket", "page_id", "host", "path", "hosts", F.least("best", best).alias("best")
        )
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
