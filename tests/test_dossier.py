import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import dossier as ds
from quillspark.operators.prefix import running
from quillspark.operators.similar import similar
from quillspark.sources import sinks
from quillspark.sources import tables as src


def facts(spark, *paths):
    rows = [(i, p, "", "", i + 1) for i, p in enumerate(paths)]
    return ds.with_path_facts(spark.createDataFrame(rows, "input_ord long, duong_dan_file string, so_van_ban string, nhiem_ky string, n_pages int"))


def test_path_facts(spark):
    got = [(r.so_ho_so, r.so_va_ky_hieu_ho_so, r.so_van_ban, r.nhiem_ky) for r in facts(spark, "12/a.pdf", "HS34b/3001_0001.pdf", "luu/3001_0001.pdf", "luu/4567x.pdf", "luu/x.pdf", "Nhiệm kỳ 3/2010_2015/x.pdf", "x.pdf").orderBy("input_ord").collect()]
    assert got == [("12", "12", "", ""), ("34", "3001_0001", "0001", ""), ("3001", "3001_0001", "0001", ""), ("4567", "4567", "", ""), ("", "luu", "", ""), ("2010", "2010", "", "2010-2015"), ("", "", "", "")]


def test_totals_and_catalogue(spark):
    rows = ds.with_dossier_totals(facts(spark, "1/a.pdf", "1/b.pdf", "2/a.pdf", "1/a.pdf", "k 2011/2013 - 2015/x.pdf"))
    got = {r.input_ord: (r.tong_so_van_ban_trong_ho_so, r.so_luong_trang_ho_so, r.muc_luc_so) for r in rows.collect()}
    assert got[0] == ("3", "6", "1") and got[1] == ("3", "6", "2") and got[3] == ("3", "6", "3") and got[2] == ("1", "3", "1")
    cat = {r["STT"]: r for r in ds.catalogue(ds.with_defaults(rows)).collect()}
    assert list(cat[1].asDict()) == list(ds.CATALOGUE) and len(ds.CATALOGUE) == 26
    assert [cat[k]["Trang Số"] for k in (1, 2, 4)] == [1, 2, 4] and cat[1]["Loại văn bản"] == "bản chính"
    old = ds.catalogue(rows, compat=True, batch=2).orderBy("Địa chỉ tài liệu gốc").collect()
    assert all(r["Số lượng trang hồ sơ"] == "" for r in old) and max(r["STT"] for r in old) == 2


def test_running_against_plain(spark):
    r = random.Random(0)
    rows = [(r.choice(["a", "b", None]), k, r.randrange(9)) for k in r.sample(range(1000), 300)]
    got = running(spark.createDataFrame(rows, "k string, o long, v int"), ["k"], "o", {"s": F.col("v")}, width=16).collect()
    assert len(got) == 300
    for x in got:
        assert x.s == sum(v for k, o, v in rows if k == x.k and o < x.o)


def test_shapes(spark):
    r = spark.createDataFrame([("", "b", None)], "co_quan_ban_hanh string, co_quan string, issuer string")
    assert r.select(ds.shaped(r, ds.CATALOGUE, True)["Cơ quan ban hành"], ds.shaped(r, ds.BRIEF, False)["Cơ quan ban hành"]).first()[:] == ("", "b")
    assert ds.english(r).first().asDict() == dict.fromkeys(ds.ENGLISH, "")


def test_similar(spark):
    from difflib import SequenceMatcher

    r = random.Random(1)
    text = lambda n: " ".join(r.choice(["họp", "tổng", "kết", "năm", "kế", "hoạch", "chi"]) for _ in range(n))
    refs = [(k, f"r{k}", text(r.choice([3, 8, 60]))) for k in range(30)] + [(30, "null", None), (31, "same", "họp tổng kết"), (32, "tie", "họp tổng kết")]
    docs = [(k, text(r.choice([2, 7, 50]))) for k in range(12)] + [(12, "Họp  tổng kết"), (13, None), (14, "")]
    got = similar(spark.createDataFrame(docs, "id int, s string"), spark.createDataFrame(refs, "ord int, id string, summary string"), "id", "s").collect()
    want = []
    for k, s in docs:
        s = " ".join((s or "").lower().split())
        found = sorted(((SequenceMatcher(None, s, v.lower()).ratio(), -o, i) for o, i, v in refs if v), reverse=True) if s else []
        want += [(k, n, i, x) for n, (x, _, i) in enumerate([f for f in found if f[0] >= 0.45][:3], 1)]
    assert sorted((g.id, g.rank, g.ref_id, g.ratio) for g in got) == sorted(want)


def test_ratio_is_that_of_difflib_and_gives_up_early():
    """Exact where it reaches what is asked for, also with letters too frequent to begin a match; hopeless pairs end early."""
    import time
    from difflib import SequenceMatcher

    from quillspark.operators.similar import PIECE, ratio, seeds, shares

    r = random.Random(2)
    for n in range(600):
        letters = r.choice(["ab", "abc ", "aăâbcdđeêghiklmnoôơpqrstuưvxy "])
        b = "".join(r.choices(letters, k=r.choice([0, 1, 30, 199, 200, 250])))
        a = list(b) if n % 2 else r.choices(letters, k=r.randrange(150))
        for _ in range(r.randrange(20) if a else 0):
            a[r.randrange(len(a))] = r.choice(letters + "\0\U0010ffff")
        a, floor = "".join(a), r.choice([0, 0.3, 0.45, 0.8])
        want = SequenceMatcher(None, a, b).ratio()
        assert ratio(a, b, seeds(b), floor) == want if want >= floor else ratio(a, b, seeds(b), floor) in (0.0, want)
        least = r.randrange(3, 20)
        pieces = {a[i : i + PIECE] for i in range(len(a) - PIECE + 1)}
        assert shares(a, pieces, b, least) == (least < PIECE or any(b[i : i + least] in a for i in range(len(b) - least + 1)))
    text = lambda k: "".join(r.choices("aăâbcdđeêghiklmnoôơpqrstuưvxy ", k=k))
    pairs = [(text(400), text(190)) for _ in range(60)]
    began = time.perf_counter()
    for a, b in pairs:
        assert ratio(a, b, b, 0.45) == 0.0
    mine, began = time.perf_counter() - began, time.perf_counter()
    assert all(SequenceMatcher(None, a, b).ratio() < 0.45 for a, b in pairs)
    assert mine < time.perf_counter() - began


def test_similar_with_long_summaries_and_small_blocks(spark, monkeypatch):
    """As plain difflib, with ties over blocks and summaries of 200 letters or more, which have too frequent letters."""
    from difflib import SequenceMatcher

    from quillspark.operators import similar as module

    monkeypatch.setattr(module, "BLOCK", 5)
    r = random.Random(4)
    words = ["".join(r.choices("aăâbcdđeêghiklmnoôơpqrstuưvxy", k=r.randrange(1, 8))) for _ in range(60)]
    refs = [(k, f"r{k}", " ".join(r.choices(words, k=r.choice([10, 40, 70])))) for k in range(16)]
    refs += [(k, f"r{k}", refs[k - 16][2]) for k in range(16, 24)]

    def near(t):
        w = t.split()
        for _ in range(r.randrange(12)):
            w[r.randrange(len(w))] = r.choice(words)
        return " ".join(w)

    docs = [(k, near(refs[k % 16][2])) for k in range(32)]
    got = similar(spark.createDataFrame(docs, "id int, s string"), spark.createDataFrame(refs, "ord int, id string, summary string"), "id", "s").collect()
    want = []
    for k, s in docs:
        found = sorted(((SequenceMatcher(None, s, v).ratio(), -o, i) for o, i, v in refs), reverse=True)
        want += [(k, n, i, x) for n, (x, _, i) in enumerate([f for f in found if f[0] >= 0.45][:3], 1)]
    assert sorted((g.id, g.rank, g.ref_id, g.ratio) for g in got) == sorted(want)


def test_sinks(spark, tmp_path):
    rows = ds.catalogue(ds.with_dossier_totals(facts(spark, "1/a.pdf", "1/b<&.pdf")))
    out = sinks.write_xlsx(rows, tmp_path / "x" / "k.txt", order=["Số hồ sơ", "STT"])
    assert out.suffix == ".xlsx"
    sheet = zipfile.ZipFile(out).read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 3 and 'state="frozen"' in sheet and "b&lt;&amp;.pdf" in sheet and "<f>HYPERLINK" in sheet
    with pytest.raises(ValueError):
        sinks.write_xlsx(rows.limit(0), tmp_path / "e.xlsx")
    with pytest.raises(ValueError):
        sinks.target(tmp_path / "a.PDF")
    brief = ds.brief(ds.with_dossier_totals(facts(spark, "1/é.pdf")))
    text = sinks.write_json(brief, tmp_path / "b.json").read_text(encoding="utf-8")
    assert len(json.loads(text)) == 1 and len(json.loads(text)[0]) == 12 and "é" in text
    assert sinks.write_csv(brief, tmp_path / "b.csv").read_text(encoding="utf-8").count("\n") >= 2 and sinks.write_csv(brief.limit(0), tmp_path / "c.csv") is None and not (tmp_path / "c.csv").exists()


def test_sources(spark, tmp_path):
    for p in ("b.PDF", "d/a.pdf", "x.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"one|two")
    files = src.pdf_files(spark, str(tmp_path), content=True).orderBy("input_ord").collect()
    assert [f.path.rsplit("/", 1)[1] for f in files] == ["b.PDF", "a.pdf"]
    assert src.pdf_files(spark, str(tmp_path), recursive=False).count() == 1 and src.pdf_files(spark, str(tmp_path), first=1).count() == 1
    with pytest.raises(ValueError):
        src.pdf_files(spark, ["a.txt"])
    pages = src.page_texts(src.pdf_files(spark, str(tmp_path), content=True), lambda c: [t.decode() for t in c.split(b"|")], first=1, total=lambda c: 2).collect()
    assert [p.pages for p in pages] == [["one", ""]] * 2
    (tmp_path / "r.tsv").write_text("1\t a \n\n2\tb\tc\td\te\tf\n", encoding="utf-8")
    assert [tuple(r)[1:] for r in src.reference_table(spark, str(tmp_path / "r.tsv")).orderBy("ord").collect()] == [("1", "a", "", "", ""), ("2", "b", "c", "d", "e")]
    (tmp_path / "d.json").write_text('{"x": {"a": "b"}}', encoding="utf-8")
    assert src.dictionaries(spark, str(tmp_path / "d.json"))["x"].first()[:] == (0, "a", "b") and src.dictionaries(spark, str(tmp_path / "no.json")) == {}
    boxes = [("d", 0, 10.2, 1.0, "BÁO", "F-Bold", 14.0), ("d", 0, 9.8, 2.0, "CÁO", "F", 14.0), ("d", 0, 20.0, 1.0, "x", "F", 9.0), ("d", 5, 1.0, 1.0, "Y", "F", 9.0)]
    styled = src.styles(spark.createDataFrame(boxes, "doc_path string, page_no int, top double, x double, text string, fontname string, size double")).collect()
    assert [(s.bold, s.uppercase) for s in styled] == [(["BÁO CÁO"], ["BÁO CÁO"])]


def test_incremental(spark, tmp_path):
    from quillspark.streaming.incremental import catalogue_new, new_texts

    (tmp_path / "in").mkdir()
    for k in (1, 2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"doc_path": f"{k}", "text": f"Số: {k}/QĐ"}, ensure_ascii=False), encoding="utf-8")
        catalogue_new(new_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r.doc_path, r.so_van_ban) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1", "1"), ("2", "2")]
