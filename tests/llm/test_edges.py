"""Clashing columns and empty tables."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import pii, quality, secrets, token_counts, toxicity

from .helpers import frame


def test_clashing_columns(spark):
    docs = frame(spark, ["some words", None]).withColumns({"n_tokens": F.lit("mine"), "n_words": F.lit("a"), "N_words_": F.lit("b"), "score": F.lit("s")})
    rows = token_counts.counted(docs, token_counts.model_path()).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == ["mine", "mine"] and rows[0].n_tokens_ > 0 and rows[1].n_tokens_ == 0
    rows = quality.ledger(docs).orderBy("doc_id").collect()
    assert [(r.n_words, r.N_words_, r.n_words__) for r in rows] == [("a", "b", 2), ("a", "b", 0)]
    plain = quality.ledger(docs.select("doc_id", "text")).orderBy("doc_id").collect()
    assert [r.failed for r in rows] == [r.failed for r in plain]
    model = toxicity.Model([], np.empty(0), [], [], 0.0)
    assert [(r.score, r.score_) for r in toxicity.scored(docs, model).collect()] == [("s", 0.0), ("s", 0.0)]


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert token_counts.counted(docs, token_counts.model_path()).collect() == []
    assert quality.ledger(docs).collect() == []
    assert secrets.scan(docs).collect() == []
    assert pii.pseudonymised(docs).collect() == []


def test_pii_key_of_the_session(spark, tmp_path):
    text = "mail anna.berg@example.org from 192.168.7.44 on 14/03/1987"
    frame(spark, [text, None]).write.parquet(f"{tmp_path}/documents.parquet")
    query = lambda: {r.doc_id: r.text for r in pii.op6_pii(spark, str(tmp_path)).collect()}
    public = query()
    spark.conf.set(pii.CONF, "a key of one's own")
    try:
        own = query()
    finally:
        spark.conf.unset(pii.CONF)
    assert public[1] is own[1] is None and len({text, public[0], own[0]}) == 3 and query() == public
