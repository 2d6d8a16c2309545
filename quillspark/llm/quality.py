"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger keeps the measurements and, in ``failed``, one bit for each rule that a document
fails. Policies are versioned sets of rules: applying one is a bitwise and, and ablations (what a rule rejects,
and what it alone rejects) are bitwise sums over the ledger; no text is read again.

Null and empty texts have no words, all measurements 0, and fail ``few_words``. Ratios over 0 words never fail. Repeated rows
are judged each. Extra columns are kept; measurements that clash with one of them are named with a trailing ``_``.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, free_name, read

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_stutters", "n_upper", "n_lower")

#: name -> condition on the measurements under which a document fails; the position is the bit. Only ever appended to.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "capitals": "n_upper > 2 * n_lower AND n_upper > 0",
    "few_distinct_words": "4 * n_distinct_words < n_words",
    "stutters": "5 * n_stutters > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 14 * n_words",
}

#: version -> rules whose failure rejects.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "2025-1": ("few_words", "repeated_windows", "symbols", "capitals", "few_distinct_words", "stutters", "long_words"),
    "2025-1-strict": tuple(RULES),
}
CURRENT = "2025-1"


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


class _Ids(dict):
    def __missing__(self, w):
        x = self[w] = len(self)
        return x


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    x = np.array(list(map(_Ids().__getitem__, words)), np.int64)
    # windows get numbers by doubling, 1, 2, 4, 8 words, so that equal numbers are equal words
    have, out = x, None
    size, left, at = 1, window, 0
    while left:
        if left & size:
            part = have[at : at + n]
            out = part if out is None else np.unique(out * (part.max() + 1) + part, return_inverse=True)[1]
            at += size
            left -= size
        if left:
            m = len(have) - size
            have = np.unique(have[:m] * (have.max() + 1) + have[size:], return_inverse=True)[1] if m > 0 else have
            size *= 2
    twice = np.bincount(out)[out] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    joined = b"".join(words)
    chars = len(joined.decode())
    without = lambda chars: len(text) - len(text.translate(None, chars))
    return (
        len(words),
        chars,
        without(b"#*$%&|<>"),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        len(set(words)),
        sum(map(bytes.__eq__, words, words[1:])),
        without(bytes(range(65, 91))),
        without(bytes(range(97, 123))),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed``; a name that ``docs`` has gets underscores behind. An empty table gives
    no rows."""
    name = {m: free_name(docs, m) for m in (*MEASURES, "failed")}

    def make():
        def run(texts):
            rows = [measure(t) for t in texts]
            return [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]

        return run

    out = add_columns(docs, text, [T.StructField(name[m], T.LongType()) for m in MEASURES], make)
    failed = F.lit(0).cast("long")
    for bit, rule in enumerate(RULES.values()):
        for m in MEASURES:
            rule = rule.replace(m, f"`{name[m]}`") if name[m] != m else rule
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn(name["failed"], failed)


def kept(policy: str = CURRENT, failed: str = "failed") -> "F.Column":
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(ledger: DataFrame, policy: str = CURRENT, failed: str = "failed") -> DataFrame:
    """(rule, n_failed, n_alone) for each rule of the policy: documents that fail it, and those that no other rule of the
    policy rejects. Documents are first counted by mask, so that the sums run over at most 2^rules rows."""
    by = ledger.groupBy(F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    bits = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if r in POLICIES[policy])))
    each = by.withColumn("b", bits).select("b.rule", "b.bit", "m", "n")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(total(hit).alias("n_failed"), total(F.col("m") == F.col("bit")).alias("n_alone"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("failed").bitwiseAND(F.lit(mask("base")).cast("long")) != 0
    return rows.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & kept()).alias("kept"), *MEASURES[5:], "failed")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), g AS (
  SELECT r, i, w[i : i + 7] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), h AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1
), c AS (
  SELECT r, count(DISTINCT i + k) AS n FROM h CROSS JOIN range(8) AS x(k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct_words,
    CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutters,
    CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^a-z]', '', 'g')) AS BIGINT) AS n_lower
  FROM d JOIN l USING (r) LEFT JOIN c USING (r)
), f AS (
  SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_upper > 2 * n_lower AND n_upper > 0 THEN 8 ELSE 0 END
    + CASE WHEN 4 * n_distinct_words < n_words THEN 16 ELSE 0 END + CASE WHEN 5 * n_stutters > n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 64 ELSE 0 END + CASE WHEN word_chars > 14 * n_words THEN 128 ELSE 0 END AS BIGINT) AS failed FROM m
)
SELECT *, failed & 3 <> 0 AS base_failed, failed & 191 = 0 AS kept FROM f
"""
