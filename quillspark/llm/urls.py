"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A listed URL is a host and a path, like ``example.com/en/``; it fits that host and all its subdomains where the path starts with
its path. A URL's keys are each suffix of its host at a dot with each beginning of its path that has the length of a
listed path. All keys are tested in the filter where the URL lies: one 64-bit word for each key (a block), four bits in
it. Only possible hits leave their row and are joined, by equality, with the list; what the filter passed wrongly finds
nothing there. Of the entries that fit, the rank that the caller gave decides, then the longest, then the least by code point.

The filter has ``BITS`` bits an entry, for up to ``MOST_BLOCKS`` words (8 MB, 4,194,304 entries); a longer list makes it let more
through, and the join still decides. Rows without a possible hit are neither moved nor joined; the list is broadcast if it
is known to be short (``checked``), so that a URL on a third of all pages is no more work than another, and beyond that a
shuffled join splits what is skewed. Null URLs, and those without ``://``, have an empty host and path, no rule, and the
verdict of no entry. Repeated rows are judged each. An empty list matches nothing, an empty table gives no rows; entries with
a null key are left out, and of entries with the same key and rank the least verdict counts. Columns of the caller stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, free_name, read

BITS, MOST_BLOCKS = 16, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the contract.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: The method's own list, for URLs that no rule fits: sites of advertisements, gambling, spam and adult content.
SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple(f"{s}.example.{t}/" for s in SITES for t in ("com", "net", "org"))


def _rest(url: str) -> "F.Column":
    """What follows the first ``://``."""
    return F.coalesce(F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) END"), F.lit(""))


def host_of(url: str) -> "F.Column":
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str) -> "F.Column":
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _block(key: "F.Column", blocks: int) -> "F.Column":
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: "F.Column") -> "F.Column":
    h, out = F.xxhash64(key), F.lit(0).cast("long")
    for k in (20, 28, 36, 44):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return out


def _table(values: list[int]) -> "F.Column":
    """A constant array, made from one constant string (a column for each value would be millions of calls)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bloom(entries: DataFrame) -> tuple[list[int], int]:
    """The words of the filter of ``entries.key``."""
    n = entries.count()
    blocks = 1
    while blocks * 64 < n * BITS and blocks < MOST_BLOCKS:
        blocks *= 2
    words = [0] * blocks
    for r in entries.groupBy(_block(F.col("key"), blocks).alias("b")).agg(F.bit_or(_bits(F.col("key"))).alias("w")).toLocalIterator():
        words[r["b"]] = r["w"]
    return words, blocks


def judge(pages: DataFrame, entries: DataFrame, url: str = "url", host: str = "host", path: str = "path", best: str = "best") -> DataFrame:
    """``pages`` with the columns ``host``, ``path`` and ``best``, the struct (rank, key, verdict) of the entry that decides, or null.
    ``entries``: (key, rank int, verdict)."""
    entries = entries.select("key", "rank", "verdict").where("key is not null").groupBy("key", "rank").agg(F.min("verdict").alias("verdict"))
    words, blocks = bloom(entries)
    # whether a listed path has the length: as many flags as the longest listed path has characters
    lengths = {r["n"] for r in entries.select((F.length("key") - F.instr("key", "/") + 1).alias("n")).distinct().toLocalIterator()}
    longest = max(lengths, default=1)
    flags, table = _table([int(k in lengths) for k in range(1, longest + 1)]), _table(words)
    mine = {k: free_name(pages, k) for k in ("passed_", "row_")}
    found = pages.withColumns({host: host_of(url), path: path_of(url)})
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    most = F.least(F.length(path), F.lit(longest))
    fits = F.when(most > 0, F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda n: F.element_at(flags, n) == 1)).otherwise(F.array().cast("array<int>"))
    begins = F.transform(fits, lambda n: F.substring(F.col(path), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(begins, lambda p: F.concat(h, p))))
    passed = F.when(F.col(host) != "", F.filter(keys, lambda k: F.element_at(table, _block(k, blocks) + 1).bitwiseAND(_bits(k)) == _bits(k))).otherwise(F.array().cast("array<string>"))
    found = found.withColumn(mine["passed_"], passed)
    kind = "struct<rank:int,n:int,key:string,verdict:string>"
    bare = found.where(F.size(mine["passed_"]) == 0).drop(mine["passed_"]).withColumn(best, F.lit(None).cast(kind))
    # possible hits: a row for each key, joined with the list, and put together again by a number of the row
    hits = found.where(F.size(mine["passed_"]) > 0).withColumn(mine["row_"], F.monotonically_increasing_id())
    columns = [*pages.columns, *(c for c in (host, path) if c not in pages.columns)]
    hits = hits.select(F.struct(*columns).alias("page"), F.col(mine["row_"]).alias("row"), F.explode(mine["passed_"]).alias("key"))
    hits = hits.join(checked(entries), "key", "left")
    # the smallest rank, then the longest key, then the least
    hit = F.when(F.col("rank").isNotNull(), F.struct(F.col("rank").cast("int").alias("rank"), (-F.length("key")).alias("n"), "key", "verdict"))
    hits = hits.groupBy("row").agg(F.first("page").alias("page"), F.min(hit).cast(kind).alias("hit"))
    hits = hits.select(*(F.col("page")[c].alias(c) for c in columns), F.col("hit").alias(best))
    return bare.select(*columns, best).unionByName(hits)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    entries = spark.createDataFrame([(k, 0, v) for k, v in RULES] + [(k, 1, "block") for k in LISTED], "key string, rank int, verdict string")
    return judge(pages, entries).select(
        "page_id", "host", "path", F.when(F.col("best.rank") == 0, F.col("best.key")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.when(F.col("best.rank") == 1, F.col("best.key")).alias("listed"),
    )


_VALUES = ", ".join(f"('{k}', 0, '{v}')" for k, v in RULES) + ", " + ", ".join(f"('{k}', 1, 'block')" for k in LISTED)
OP7_SQL = rf"""
WITH e(key, rank, verdict) AS (VALUES {_VALUES}),
p AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p
), u AS (SELECT DISTINCT host, path FROM h),
m AS (
  SELECT host, path, arg_min(struct_pack(key := key, rank := rank, verdict := verdict), (rank, -length(key), key)) AS best
  FROM u JOIN e ON (host = split_part(key, '/', 1) OR ends_with(host, '.' || split_part(key, '/', 1)))
    AND starts_with(path, substr(key, position('/' IN key))) GROUP BY host, path
)
SELECT page_id, h.host, h.path, CASE WHEN best.rank = 0 THEN best.key END AS rule, coalesce(best.verdict, 'allow') AS verdict,
  CASE WHEN best.rank = 1 THEN best.key END AS listed
FROM h LEFT JOIN m ON h.host = m.host AND h.path = m.path
"""
