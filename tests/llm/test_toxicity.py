import math
import random
import resource
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import toxicity as X
from quillspark.llm.common import give_back, read

from .helpers import ODD, frame, prose, words


def labelled(spark, n=240):
    r = random.Random(5)
    texts = [prose(i, 40, 300) + (" vile vileness" if i % 4 == 0 else "") + (" " + prose(i, 40, 300) if r.random() < 0.5 else "") for i in range(n)]
    return texts, spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


def test_index_is_exact():
    r = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        t = np.unique(r.integers(0, 50, r.integers(0, 9)))
        w = r.random(len(t)).astype(np.float32)
        rows.append((t, w / np.float32(max(np.linalg.norm(w), 1e-9))))
    order = X.like_order(rows, 50, 16)
    assert sorted(order.tolist()) == list(range(300))
    rows = [rows[i] for i in order]
    index, dense = X.BlockMaxIndex(rows, 50, block=16), np.zeros((300, 50), np.float32)
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for (t, w), (ids, sims) in zip(rows, index.nearest(rows, 10), strict=True):
        q = np.zeros(50, np.float32)
        q[t] = w
        all_ = dense @ q
        want = np.sort(all_[all_ > 0])[::-1][:10]
        assert np.allclose(sims, want, atol=1e-5) and np.allclose(all_[ids], sims, atol=1e-5)


def test_held_out(spark):
    texts, labels = labelled(spark)
    docs = frame(spark, texts)
    model = X.fit(docs, labels, train=X.crc_fold("doc_id") != 1)
    rows = X.scored(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 40
    assert all((r.score >= X.THRESHOLD) == (r.doc_id % 4 == 0) for r in held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for r in rows for i in r.evidence)


def test_scores_against_brute_force(spark):
    """Vectors, votes and calibration made again in plain Python over all pairs of texts and examples."""
    texts, labels = labelled(spark, 160)
    docs = frame(spark, texts + ODD)
    model = X.fit(docs, labels, train=F.col("doc_id") < 100)
    y, examples = [int(i % 4 == 0) for i in range(100)], texts[:100]

    def counts(t):
        c = {}
        for w in words(t):
            w = w.encode()
            for x in [w, *(w[:n] + b"*" for n in (4, 5) if len(w) > n)]:
                c[x] = c.get(x, 0) + 1
        return c

    have = [counts(t) for t in examples]
    weight = {}
    for term in {t for c in have for t in c}:
        a, b = (sum(term in c for c, v in zip(have, y, strict=True) if v == k) for k in (1, 0))
        c, d = 25 - a, 75 - b
        chi = 100 * (a * d - b * c) ** 2 / max((a + b) * (c + d) * (a + c) * (b + d), 1)
        weight[term] = (math.log(101 / (1 + a + b)) + 1) * (X.FLOOR + (chi**4 / (chi**4 + X.SURE**4) if a * 75 > b * 25 else 0))

    def vector(c):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in c.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = [vector(c) for c in have]

    def vote(v, skip=None):
        cos = sorted(((sum(x * u.get(t, 0) for t, x in v.items()), y[i]) for i, u in enumerate(vectors) if i != skip), reverse=True)
        near = [(s / (1.05 - min(s, 1)), k) for s, k in cos[: X.NEIGHBOURS] if s > 1e-12]
        return sum(w for w, k in near if k) / sum(w for w, _ in near) if near else model.bare

    votes = np.array([vote(v, i) for i, v in enumerate(vectors)])
    slope, shift = X.platt(votes, np.array(y, float), np.ones(100))
    for r in X.scored(docs, model).collect():
        p = min(max(vote(vector(counts(r.text))), 0.001), 0.999)
        want = 1 / (1 + math.exp(-(slope * math.log(p / (1 - p)) + shift)))
        assert abs(r.score - want) < 1e-6, (r.doc_id, r.score, want)


def test_held_out_recall(spark):
    """Documents and labels of the given tables, a third of the labels held out."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = X.fit(docs, labels, train=X.crc_fold("doc_id") != 1)
    assert all(len(t) for t in (model.index.at, model.index.weight))
    rows = X.scored(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where(X.crc_fold("doc_id") == 1).select("score", "toxic").collect()
    hit = [r.score >= X.THRESHOLD for r in rows if r.toxic == 1]
    false = [r.score >= X.THRESHOLD for r in rows if r.toxic == 0]
    assert len(hit) >= 10 and sum(hit) >= 0.8 * len(hit) and sum(false) <= 0.02 * len(false), (sum(hit), len(hit), sum(false), len(false))


def test_odd_rows_and_labels(spark):
    texts, labels = labelled(spark)
    docs = frame(spark, ODD + texts, start=-len(ODD)).withColumn("score", F.lit("mine"))
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (5, None, None), (7, 1, 3), (9, 1, 1), (9, 1, 1), (99999, 1, 1)], labels.schema))
    model = X.fit(docs, labels)
    rows = X.scored(docs, model, "my_score").collect()
    assert len(rows) == len(ODD) + len(texts) and all(0 <= r.my_score <= 1 and r.score == "mine" for r in rows)
    assert all(r.my_score < X.THRESHOLD for r in rows if not r.text)
    assert X.scored(frame(spark, []), model).count() == 0


def test_no_labels_and_one_class(spark):
    docs, schema = frame(spark, ["a b", None]), "doc_id long, toxic int"
    assert [r.score for r in X.scored(docs, X.fit(docs, spark.createDataFrame([], schema))).collect()] == [0, 0]
    assert [r.score for r in X.scored(docs, X.fit(docs, spark.createDataFrame([(0, 1)], schema))).collect()] == [1, 1]


def test_stage_keeps_columns(spark, tmp_path):
    texts, labels = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, [*texts, None]).withColumn("toxicity_score", F.lit(1))
    out = X.toxicity_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i in range(len(texts) + 1) if i % 4 or i == len(texts)}


def test_driver_keeps_no_freed_memory(spark, sf):
    """Learning frees several times the model's room; all of it is back with the system when the stage's plan is made."""

    def resident():
        with open("/proc/self/statm") as f:
            return (int((x := f.read().split())[1]) - int(x[2])) * resource.getpagesize() / 1e6

    docs = read(spark, sf, "documents")
    give_back()
    clean = X.toxicity_stage(spark, docs, sf)
    held = resident()
    give_back()
    assert held - resident() < 3 and clean.columns == docs.columns


def test_vectors_take_the_place_of_counts():
    """The model's making holds the examples' terms a few times at most, and not their counts beside the vectors."""
    r = np.random.default_rng(1)
    rows = [(r.choice(20_000, 500, replace=False).astype(np.int32), np.ones(500, np.int32)) for _ in range(800)]
    names, y = [b"%d" % i for i in range(20_000)], np.arange(800) % 2.0
    tracemalloc.start()
    try:
        model = X.Model(list(range(800)), y, rows, names, 0.5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == [] and len(model.ids) == 800 and peak < 80 * 400_000
