"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected ``target / source_size`` times. Along the documents of a source, ordered by size and
id, these expectations are summed up from one random offset of the source; a document is taken once for each whole
number that the sum crosses at it. The order by size makes the words taken follow the target closely.

Sources in code point order, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words; no target is above
``MOST`` times its source's size, and what that frees goes to the others by weight until none is above.

A hot source is no single task's: rows are range-partitioned by (source, size, id), numbered within their
partition, and the partitions' counts (a row for each partition and source) are summed up. The table of sizes is written
first, so that texts are read once and the numbering doesn't change when a task runs again.

Null and empty texts have size 0, are counted like others in the order, and take no words. A null source is a source of
its own, another than ''. Rows that repeat an id are documents each; equal rows may change places without any difference
to the result. A source without words has target 0 and no document is taken of it. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_name, read, written

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), (3, 2), 2, "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(source, source_size, target) from (source, size): a row for each source.

    Sources are capped in the order of cap to weight; the first whose share of the rest is under its cap, and all behind
    it, get theirs. (What sums to 150 % is always under the sum of the caps.)"""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * MOST)
    ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    goal = F.sum("source_size").over(whole) * F.lit(share[0]) / F.lit(share[1])
    capped = F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", (goal - capped) / rest)
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(whole)["level"]
    by = by.withColumn("fair", level)
    return by.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("fair") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def offset(source: "F.Column", seed: str = SEED) -> "F.Column":
    """The random offset of a source, in [0, 1)."""
    name = F.coalesce(F.concat(F.lit(f"{seed}:s"), source), F.lit(f"{seed}:n"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of each row of ``docs`` (doc_id, text, source)."""
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE_CLASS)), F.lit(0)).cast("long")
    sized = written(docs.select("doc_id", "source", size.alias("size")), "sizes")
    goals = targets(sized)
    place = sized.repartitionByRange(F.col("source").asc_nulls_last(), "size", "doc_id").sortWithinPartitions(F.col("source").asc_nulls_last(), "size", "doc_id")
    placed = written(place.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "placed")
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("s"), "part", (before - F.col("first")).alias("shift"))
    goals = goals.select(F.col("source").alias("s_"), "source_size", "target")
    rows = placed.join(counts, F.col("source").eqNullSafe(F.col("s")) & (placed["part"] == counts["part"])).join(goals, F.col("source").eqNullSafe(F.col("s_")))
    k = (F.col("at") + F.col("shift")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = F.floor(u + (k + 1) * rate) - F.floor(u + k * rate)
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


#: The same rows: weights in turn, water filling over sources, and ranks times rates from the same offset.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () * 3 AS DOUBLE) / 2
    - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (
  SELECT *, (SELECT arg_min(level, CAST(cap AS DOUBLE) / w) FROM l WHERE level * w <= cap) AS fair FROM l
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(fair * w, CAST(cap AS DOUBLE))) AS target,
    CAST(CAST('0x' || substr(md5(coalesce('mix-1:s' || source, 'mix-1:n')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM f
), k AS (
  SELECT d.*, CAST(row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS DOUBLE) AS k FROM d
), c AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, k.source,
    CAST(floor(t.u + (k.k + 1) * CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END)
       - floor(t.u + k.k * CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS BIGINT) AS copies
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies FROM c
"""


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, with the columns it came with.

    Ranks stay with their rows by a number given to them in a written copy of ``docs``, as ids may be null or repeat."""
    n = free_name(docs, "row_number")
    whole = written(docs.withColumn(n, F.monotonically_increasing_id()), "numbered")
    counts = mix(whole.select(F.col(n).alias("doc_id"), "text", "source")).select(F.col("doc_id").alias(n), F.col("copies").alias(f"{n}_copies"))
    taken = whole.join(counts.where(f"{n}_copies > 0"), n)
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{n}_copies")))).select(*docs.columns)
