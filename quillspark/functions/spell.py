"""TX-20: spelling correction against a list of terms, by symmetric deletion.

A word and a term at edit distance 1 share a string that is one of them or lacks one letter of it. Distinct words and terms are joined
on these strings, by equality, and verified; no word is compared with the whole list. Off unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _deletions(word: Column) -> Column:
    """The word, and the word without each of its letters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def corrections(words: DataFrame, terms: DataFrame, word: str = "word", term: str = "term") -> DataFrame:
    """(word, correction) of each distinct lower-case word that is no term but is one edit from some; the least such term."""
    terms = terms.select(F.lower(term).alias("_term")).where("_term <> ''").distinct()
    unknown = words.select(F.lower(word).alias("word")).where("length(word) > 1").distinct().join(terms, F.col("word") == F.col("_term"), "left_anti")
    left = unknown.select("word", F.explode(_deletions(F.col("word"))).alias("_key"))
    right = terms.select("_term", F.explode(_deletions(F.col("_term"))).alias("_key"))
    near = left.join(right, "_key").where(F.levenshtein("word", "_term") <= 1)
    return near.groupBy("word").agg(F.min("_term").alias("correction"))


def corrected_text(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, text) with every word between spaces that has a correction replaced by it; ``key`` tells rows apart."""
    words = docs.select(key, F.posexplode(F.split(text, " ")).alias("_at", "_word"))
    fixes = corrections(words, terms, "_word")
    fixed = words.join(fixes, F.lower("_word") == F.col("word"), "left").withColumn("_word", F.coalesce("correction", "_word"))
    rows = F.array_sort(F.collect_list(F.struct("_at", "_word")))
    return fixed.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["_word"]), " ").alias(text))
