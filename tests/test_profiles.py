from pyspark.sql import functions as F

from quillspark.functions import spell
from quillspark.operators import dossier as ds
from quillspark.plans import profiles

PAGES = ["SỞ Y TẾ\nSố: 12/KH-SYT\nHuế, ngày 2/3/2020\nKẾ HOẠCH\nVề việc tiêm chủng mở rộng", "", "GIÁM ĐỐC\nLê Văn Bình"]


def test_plain(spark):
    rows = {r.path: r for r in profiles.plain(spark.createDataFrame([("a", PAGES), ("b", None), ("c", ["x"])], "path string, pages array<string>")).collect()}
    assert set(rows) == {"a", "c"} and rows["a"].so_trang_van_ban == "3" and rows["a"].the_loai_van_ban == "KẾ HOẠCH" and rows["a"].nguoi_ky == "Lê Văn Bình"


def test_markdown(spark):
    docs = spark.createDataFrame([("a", PAGES, ["KẾ HOẠCH"], ["SỞ Y TẾ"]), ("b", ["gì"], [], None)], "path string, pages array<string>, bold array<string>, upper array<string>")
    (r,) = profiles.markdown(docs).collect()
    assert r.path == "a" and "**KẾ HOẠCH**" in r.markdown_text and "# SỞ Y TẾ" in r.markdown_text and (r.the_loai_van_ban, r.co_quan_ban_hanh) == ("KẾ HOẠCH", "SỞ Y TẾ")


def test_by_dossier(spark):
    docs = spark.createDataFrame(
        [("HS7/a.pdf", 0, PAGES, {0: ["KẾ HOẠCH"]}), ("HS7/b.pdf", 1, PAGES[:1], None), ("HS7/c.pdf", 2, ["", " "], None)], "duong_dan_file string, input_ord long, pages array<string>, page_styles map<int,array<string>>"
    )
    rows = {r.duong_dan_file: r for r in profiles.by_dossier(docs).collect()}
    assert set(rows) == {"HS7/a.pdf", "HS7/b.pdf"}
    a = rows["HS7/a.pdf"]
    assert (a.so_ho_so, a.so_luong_trang_ho_so, a.tong_so_van_ban_trong_ho_so, a.muc_luc_so, a.ngay_ban_hanh, a.loai_ban) == ("7", "4", "2", "1", "02/03/2020", "bản chính")
    cat = ds.catalogue(profiles.by_dossier(docs)).orderBy("STT").collect()
    assert [(r["Trang Số"], r["Số trang"], r["Số lượng trang hồ sơ"]) for r in cat] == [(1, 3, "4"), (4, 1, "4")]


def test_spelling(spark):
    terms = spark.createDataFrame([("quyết",), ("định",), ("nghị",)], "term string")
    docs = spark.createDataFrame([(1, "Quyế địnhh  của nghị"), (2, "")], "id int, t string")
    assert {r.id: r.t for r in spell.corrected_text(docs, "id", "t", terms).collect()} == {1: "quyết định  của nghị", 2: ""}
