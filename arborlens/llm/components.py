"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.work import discard, materialize


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links over longs, in any direction, loops and repeats allowed -> (node, root): root is the smallest
    node of the component; nodes without a link to another node have no row.

    Alternates large-star and small-star steps (every node hands its larger, then its smaller neighbours to its
    smallest one), which need O(log n) rounds whatever the diameter. Each round is one aggregate and one join whose
    sides are both plain shuffles of written tables, so that adaptive execution splits a hub's rows. Only a row count
    and a checksum reach the driver.
    """
    e = F.col
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(e("u") != e("v"))
    links = materialize(links.distinct(), "links")
    seen = _digest(links)
    while seen[0]:
        both = links.unionByName(links.select(e("v").alias("u"), e("u").alias("v")))
        low = materialize(both.groupBy(e("u").alias("w")).agg(F.least(F.min("v"), e("w")).alias("m")), "low")
        large = both.join(low, both.u == low.w).where(e("v") > e("u"))
        large = materialize(large.select(e("v").alias("u"), e("m").alias("v")).where(e("u") != e("v")).distinct(), "large")
        discard(low)
        low = materialize(large.groupBy(e("u").alias("w")).agg(F.min("v").alias("m")), "low")
        small = large.join(low, large.u == low.w)
        small = small.select(e("v").alias("u"), e("m").alias("v")).unionByName(low.select(e("w").alias("u"), e("m").alias("v")))
        small = materialize(small.where(e("u") != e("v")).distinct(), "links")
        discard(low)
        discard(large)
        discard(links)
        links, before, seen = small, seen, _digest(small)
        if before == seen:
            break
    return links.select(e("u").alias("node"), e("v").alias("root"))
