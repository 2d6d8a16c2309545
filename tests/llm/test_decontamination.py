import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import decontamination as D

from .helpers import ODD, frame, prose, words


def brute(texts, items):
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            for k in range(max(1, len(v) - 7) if v else 0):
                p = v[k : k + 8]
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit.update(range(j, j + len(p)))
                        found.add("" if i is None else str(i))
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def cases():
    r = random.Random(1)
    items = [(i, prose(i, r.choice([1, 3, 8, 9, 20]), 6)) for i in range(8)] + [(8, None), (9, ""), (None, "Null item has eight words and one more"), (3, prose(33, 9, 6)), (10, "Same text here")]
    texts = ODD + [prose(100 + i, r.choice([5, 50, 300]), 7) for i in range(12)] + ["x " + items[4][1] + " - " + items[5][1] + " y", "NULL item, has; eight words and ONE more!"]
    return texts, items


def test_against_brute_force(spark):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (D.BLOCK_WORDS, 12):  # one block, and an item or two in each
        found = D.contamination(frame(spark, texts), D.phrase_blocks(bench, block_words=block)).orderBy("doc_id").collect()
        for row, t, (n, hit, ids) in zip(found, texts, brute(texts, items), strict=True):
            assert (row.found.n_words, row.found.n_hit, row.found.items) == (n, len(hit), ids), t
            if hit:
                assert words("".join(t[s.start : s.end] + " " for s in row.found.spans)) == [words(t)[k] for k in hit]
            else:
                assert row.found.spans == []


def test_index_counts_and_places():
    r = np.random.default_rng(3)
    for n in (1, 2, 30, 500):
        seq = np.concatenate([r.integers(0, 5, n), [0]])
        index = D.FMIndex(seq, 4, sample=4)
        phrases = np.array([[0, 0, 1], [0, 1, 2], [3, 3, 4], [1, 2, 1], [4, 4, 4]])
        lengths = np.array([1, 2, 3, 3, 3])
        low, high = index.rows(phrases, lengths)
        for p, k, a, b in zip(phrases, lengths, low, high, strict=True):
            p = p[3 - k :].tolist()
            places = [i for i in range(len(seq) - k + 1) if seq[i : i + k].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def test_no_items_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = D.contamination(frame(spark, ["a b"]), D.phrase_blocks(none)).collect()
    assert (rows[0].found.n_words, rows[0].found.n_hit, rows[0].found.items) == (2, 0, [])
    assert D.contamination(frame(spark, []), D.phrase_blocks(none)).count() == 0


def test_query(spark, sf):
    rows = D.op1_decontamination(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    some = [r for r in rows if r.n_hit or r.doc_id % 40 == 0]
    assert len(rows) == len(docs) and some
    for r in some:
        ((n, hit, ids),) = brute([docs[r.doc_id]], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(ids), len(ids) >= 2)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_stage_cuts_and_drops(spark, tmp_path):
    a, b = prose(1, 12, 30), prose(2, 12, 30)
    spark.createDataFrame([(1, a), (2, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, ["clean text stays", f"before {a}. after", f"{a} {b}", None]).withColumn("contamination", F.lit(1))
    rows = {r.doc_id: r for r in D.decontamination_stage(spark, docs, str(tmp_path)).collect()}
    assert set(rows) == {0, 1, 3} and rows[0].text == "clean text stays" and rows[3].text is None
    assert rows[1].text == "before . after" and rows[1].n_chars == len("before . after") and rows[1].contamination == 1


def test_stage_cuts_many_passages_of_a_long_text(spark, tmp_path):
    item = prose(1, 12, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [f"é日 {item} | " * 3000, "", "clean"])
    rows = {r.doc_id: r.text for r in D.decontamination_stage(spark, docs, str(tmp_path)).collect()}
    assert rows == {0: "é日  | " * 3000, 1: "", 2: "clean"}


def test_workers_hold_one_block():
    class Lazy:
        _path = "somewhere"

        @property
        def value(self):
            if not hasattr(self, "_value"):
                self._value = object()
            return self._value

    blocks = [Lazy() for _ in range(10)]
    for _ in range(2):
        for p in D.opened(blocks):
            assert [b for b in blocks if hasattr(b, "_value")] == [b for b in blocks if getattr(b, "_value", None) is p]
    assert next(D.opened(blocks[:1])) is blocks[0]._value and list(D.opened(blocks[:1])) == [blocks[0]._value]


def test_clashing_name(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = frame(spark, ["x a b c y"]).withColumn("found", F.lit("mine"))
    (row,) = D.contamination(docs, D.phrase_blocks(bench), rest=True).collect()
    assert row.found == "mine" and row.found_.n_hit == 3 and row.found_.rest == "x  y"
