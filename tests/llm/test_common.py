import os
import time

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import functions as F

from quillspark.llm import toxicity
from quillspark.llm.common import BATCH_BYTES, in_arrow, read, written


def test_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {n for d in folders for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}

    before, set_before = files(), spark.conf.get(key, None)
    out, late = written(spark.range(100_000).groupBy((F.col("id") % 1000).alias("g")).count(), "sums"), time.time() + 10
    while not files() <= before and time.time() < late:  # they are deleted in the background
        time.sleep(0.1)
    left = files() - before
    assert not left and out.count() == 1000 and spark.conf.get(key, None) == set_before


def test_workers_get_bounded_batches(spark):
    """Rows of 100 kB: a batch has no more than the limit and a row, and all of them come through."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, kind, before = spark.range(400, numPartitions=1).select("id", F.repeat(F.lit("x"), 100_000).alias("text")), "rows long, bytes long", spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    try:
        got = in_arrow(docs, sizes, kind).collect()
        assert sum(r["rows"] for r in got) == 400 and max(r["bytes"] for r in got) < BATCH_BYTES + 200_000
        spark.conf.set(key, "1m")  # a caller's lower limit holds
        assert max(r["bytes"] for r in in_arrow(docs, sizes, kind).collect()) < 1_300_000 and spark.conf.get(key) == "1m"
        spark.conf.set(key, "64m")
        toxicity.scored(docs.withColumnRenamed("id", "doc_id"), toxicity.Model([], np.empty(0), [], [], 0.0))
        assert int(spark.conf.get(key)) == BATCH_BYTES
    finally:
        spark.conf.set(key, before)


def test_examples_need_no_second_kind_of_worker(spark, sf, monkeypatch):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")

    def refused(*_, **__):
        raise AssertionError("rows of Python objects start workers of another kind")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    model = toxicity.fit(docs, labels)
    assert len(model.ids) > 1 and sorted(set(model.y)) == [0, 1]
    assert toxicity.fit(docs, labels.limit(0)).trivial == 0 and toxicity.fit(docs.limit(0), labels).ids == []
