"""Connected components of a table of links, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of ``links`` (two long columns) the smallest node that links reach.

    Alternates large-star and small-star steps: every node hands its neighbours on to its smallest one. Each step is
    a grouping by node with a minimum and a join, so that a node of many links is summed up where they lie; the rounds
    are logarithmic in the longest chain. Loops and repeated links do no harm; no links give no rows."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: all neighbours, those greater than the node move on; small: only neighbours smaller than the node
        n = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        n = n.union(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else n
        low = n.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        moved = n.join(low, "u")
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        kept = out if large else out.union(low.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
        return kept.where("a <> b").distinct()

    e = links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b").distinct()
    e, before = written(e, "links"), None
    while True:
        e = written(star(star(e, True), False), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    top = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(top)
