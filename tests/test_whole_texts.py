"""Queries that take the whole text of a document, against plain Python."""

import re
from difflib import SequenceMatcher

from quillspark.plans.queries import QUERIES


def documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def summary(text):
    out = None
    for x in re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text):
        if x := x.strip():
            out = x if out is None else out[:-1] + x if out.endswith("-") else f"{out} {x}"
    text = " ".join((out or "").split())
    low = text.strip(" -–—:;,.\"“”’'").lower()
    low = low[:1].upper() + low[1:]
    for a in dict.fromkeys(re.findall(r"\b([A-ZĐ]{2,4})\b", text)):
        low = re.sub(rf"\b{a.lower()}\b", a, low)
    return low.strip()


def test_sentence_case_takes_all_lines(spark, tmp_path):
    texts = ["", "Một", "V/v họp\nUBND tỉnh\n\nvề KẾ hoạch\nnăm của HĐND và thu-\nchi TNCN", "\n\n\n\nSau bốn dòng trống có UBND.\r\n" + "Dòng GTGT ubnd\n" * 30]
    got = {r.doc_id: r.summary for r in QUERIES["tx_sentence_case"](spark, documents(spark, tmp_path, texts)).collect()}
    assert got == dict(enumerate(map(summary, texts)))


def test_similar_takes_the_whole_text(spark, tmp_path):
    items = ["Về việc tổ chức họp tổng kết năm và kế hoạch năm sau", "Phê duyệt dự toán chi", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["Về việc\ntổ chức họp\ntổng kết  năm\nvà kế hoạch năm sau", "Phê duyệt dự toán chi\n" + "nội dung khác hẳn, dài hơn nhiều\n" * 9, "", None, "Dự toán\nchi"]
    want = set()
    for k, t in enumerate(texts):
        s = " ".join((t or "").lower().split())
        found = sorted(((SequenceMatcher(None, s, v.lower()).ratio(), -i) for i, v in enumerate(items) if v), reverse=True) if s else []
        want |= {(k, n, -i, x) for n, (x, i) in enumerate([f for f in found if f[0] >= 0.45], 1)}
    got = QUERIES["ro_similar_topk"](spark, documents(spark, tmp_path, texts)).collect()
    assert {(r.doc_id, r.rank, r.ref_id, r.ratio) for r in got} == want and {0} <= {w[0] for w in want}
