"""Connected components of a link relation by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm._shared import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # minima are stored before the join, so that a hot centre's neighbours can be split over tasks
    low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = checkpointed(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(low, "u")
    return (
        moved.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
    )


def _signature(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()


def roots(links: DataFrame) -> DataFrame:
    """``u, v``: for each node u of ``links(u long, v long)``, except the roots themselves, the smallest node v
    of its component. Direction, repeats and loops in ``links`` do not matter.

    Each step sends a node's neighbours to their minimum, found by a map-side aggregate; a hot centre is one
    group of an aggregate and the skewed side of a join, never a collected list.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = checkpointed(links)
    seen = _signature(links)
    while seen[0]:
        links = checkpointed(_small_star(checkpointed(_large_star(links))))
        now = _signature(links)
        if now == seen:
            break
        seen = now
    return links
