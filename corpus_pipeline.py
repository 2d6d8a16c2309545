"""Toxicity, near duplicates, decontamination, mixing, token ids: five stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import read, written
from quillspark.llm.decontamination import decontamination_stage
from quillspark.llm.mixing import mixing_stage
from quillspark.llm.ngram_join import ngram_join_stage
from quillspark.llm.token_files import token_stage
from quillspark.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

#: Nearest neighbours, groups by reachability and a tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else written(docs, name)
    return docs
