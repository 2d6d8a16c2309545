"""Every stage of the pipeline against its brute-force version, on a small copy of the tables."""

import zlib

import numpy as np

import corpus_pipeline
from quillspark.llm import mixing
from quillspark.llm.token_files import Encoder, tokenizer_path

from .test_decontamination import brute as leaks
from .test_ngram_join import brute as near


def test_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "decontamination", "mixing", "token_files"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120).cache()
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        kept[name] = (docs.collect(), out.collect())
        if name != "token_files":
            assert out.columns == columns
        docs = out
    before, after = kept["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(gone - toxic) <= 2 and set(map(tuple, after)) <= set(map(tuple, before))
    before, after = kept["ngram_join"]
    root = near([r.doc_id for r in before], [r.text for r in before])
    assert {r.doc_id for r in after} == {i for i, (n, c) in root.items() if not n or i == c}
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = dict(zip([r.doc_id for r in before], leaks([r.text for r in before], items), strict=True))
    assert {r.doc_id for r in after} == {i for i, (_, _, ids) in found.items() if len(ids) < 2}
    texts = {r.doc_id: r.text for r in before}
    assert all((r.text == texts[r.doc_id]) == (not found[r.doc_id][1]) and r.n_chars == len(r.text) for r in after)
    assert not any(ids for _, _, ids in leaks([r.text for r in after], items))
    before, after = kept["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before)).collect()}
    got = [r.doc_id for r in after]
    assert all(got.count(i) == n for i, n in copies.items()) and len(got) == sum(copies.values())
    before, after = kept["token_files"]
    encode = Encoder(tokenizer_path())
    start = 0
    for g, r in zip(sorted(after, key=lambda r: r.start), sorted(before, key=lambda r: (r.doc_id, r.text)), strict=True):
        ids = np.frombuffer(encode(r.text), "<u4").tolist() + [2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
