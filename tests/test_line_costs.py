"""What makes the extractors cheap: texts normalised as a whole, first matches that stop, symbols computed once."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import extract as ex


def test_whole_texts_are_normalised_as_their_lines(spark):
    r = random.Random(5)
    bits = ["nam", "Ngay", "NGAY", "thang", "xthangx", "Hả", "Nội", "Hả  Nội", "Sô", "Trang 3", "trang", "page", "logo", "admin", " ", "  ", "\n", "\n\n", "–", "—", "Quvết định", "ngảy", "é", "Đ", "1", ".", "a"]
    odd = ["**", "# ", "[BLOCK: X]", "\t", " ", "\r\n", " ", "　", "\x1c", "\x0b"]
    texts = ["".join(r.choice(bits + odd if k % 3 == 0 else bits) for _ in range(r.randrange(40))) for k in range(600)] + ["", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("t", tx.normal_texts(F.col("t")).alias("a"), tx.normal_lines(F.col("t")).alias("b"), F.filter(tx._marked_lines(F.coalesce("t", F.lit(""))), lambda x: x["s"] != "").alias("c")).collect()
    for x in rows:
        assert x.a == [v.s for v in x.c] and x.b == x.c, repr(x.t)


def test_first_of_stops_at_the_first(spark):
    bad = lambda x: F.when(x == "stop", F.raise_error(F.lit("looked behind the first"))).when(x == "hit", x)
    df = spark.createDataFrame([(["a", "hit", "stop"],), (["a"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(tx.first_of(F.col("a"), bad)).collect()] == ["hit", None, None]
    assert [r[0] for r in df.select(tx.first_of(F.col("a"), lambda x, i: F.when(x == "hit", i), "int")).collect()] == [1, None, None]
    with pytest.raises(Exception, match="looked behind"):
        spark.createDataFrame([(["stop"],)], "a array<string>").select(tx.first_of(F.col("a"), bad)).collect()


def test_type_in_the_first_fitting_line(spark):
    docs = [(1, ["x", "QUYẾT ĐỊNH", "KẾ HOẠCH"], None), (2, ["a b"], []), (3, ["BÁO CÁO", "KẾ HOẠCH"], ["KẾ HOẠCH"]), (4, [], None)]
    df = spark.createDataFrame(docs, "i int, l array<string>, b array<string>").select("i", ex.doc_type(F.col("l"), F.col("b")).alias("t"))
    assert [tuple(r.t) for r in df.orderBy("i").collect()] == [("QUYẾT ĐỊNH", 1), ("", -1), ("KẾ HOẠCH", 1), ("", -1)]


def test_composed_replaces_what_is_there(spark):
    """All letters and marks of Vietnamese by Unicode's rule, as one of the string or many; the list of pairs isn't gone through for each text."""
    r = random.Random(6)
    letters = [c for p in tx._compositions() for c in (p[0], p[2])]
    texts = [unicodedata.normalize("NFD", "".join(r.choices(letters + ["b", " ", "\n"], k=n))) for n in (1, 2, 9, 80) for _ in range(60)]
    got = [x.c for x in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(tx.composed(F.col("t")).alias("c")).collect()]
    assert got == [unicodedata.normalize("NFC", t) for t in texts]
    assert "regexp_extract_all" in str(tx.composed(F.col("t")))


def test_a_symbol_is_computed_once_for_all_issuers():
    assert str(ex.issuer_of_symbol(F.reverse("x"))).count("reverse") == 1


def test_dates_need_four_digits_and_stop_at_the_first(spark):
    lines = [["số 123", "năm 201", "1.2.2003", "4.5.2006"], ["Căn cứ x", "1/2/2003", "Căn-cứ 3/4/2005"], ["CONG BAO 1/2/2003", "n gày 3 t háng 4 n ăm 2005"], ["1/2/03"], ["ngày 1 tháng 2 năm 200"]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, l array<string>")
    assert [r.d for r in df.orderBy("k").select(ex.date(F.col("l")).alias("d")).collect()] == ["01/02/2003", "03/04/2005", "03/04/2005", "", ""]
    assert "filter" not in str(ex.date(F.col("l")))


def test_a_summary_is_computed_once_and_white_space_is_that_of_unicode(spark):
    assert str(tx.sentence_case(F.reverse("x"))).count("reverse") == 1
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in every], "c string")
    assert df.where(F.col("c").rlike(f"^{tx.WHITE}$") != F.col("c").rlike(r"(?U)^[\s\x1c-\x1f]$")).count() == 0


def test_lines_of_an_agency_are_judged_once(spark):
    none = F.lit(None).cast("array<string>")
    assert str(ex.agency(F.reverse("l"), none, none, F.lit(-1))).count("HEADER_RIGHT") == 1
    lines = [["SỞ Y TẾ ĐẢNG BỘ tỉnh", "x"], ["ĐẢNG BỘ", "SỞ Y TẾ"], ["BỘ Y TẾ  CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"], ["C Ộ N G HOA XÃ HỘI", "BỘ A"], ["x y"], []]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, l array<string>")
    assert [r.a for r in df.orderBy("k").select(ex.agency(F.col("l"), none, none, F.lit(-1)).alias("a")).collect()] == ["SỞ Y TẾ", "ĐẢNG BỘ SỞ Y TẾ", "BỘ Y TẾ", "BỘ A", "", ""]


def test_the_signer_is_looked_for_from_the_last_line(spark):
    lines = [["CHỦ TỊCH", "Lê Văn An", "GIÁM ĐỐC", "Trần Thị Bình", "x 1"], ["GIÁM ĐỐC", "Trần Thị Bình", "Nơi nhận:", "CHỦ TỊCH", "Lê Văn An"], ["nơi nhận", "CHỦ TỊCH", "Lê Văn An"], ["Lê Văn An"], []]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, l array<string>")
    assert [r.s for r in df.orderBy("k").select(ex.signer(F.col("l")).alias("s")).collect()] == ["Trần Thị Bình", "Trần Thị Bình", "Lê Văn An", "Lê Văn An", ""]
    assert str(ex.signer(F.reverse("l"))).count("slice(reverse") <= 2


def test_a_titles_own_line_is_split_once(spark):
    assert str(ex.same_line_summary(F.reverse("x"))).count("reverse") == 1
    lines = ["QUYẾT ĐỊNH Về việc thu phí", "BÁO CÁO: kết quả năm", "QUYẾT ĐỊNH", "Thông báo abc", "x", "", "QUYẾT Ab cde f"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string")
    got = [r.s for r in df.orderBy("k").select(ex.same_line_summary(F.col("x")).alias("s")).collect()]
    assert got == ["Về việc thu phí", "CÁO: kết quả năm", "", "", "", "", "Ab cde f"]
    terms = [["nhiệm kỳ ٢٠١٥ - ٢٠٢٠"], ["nhiệm kỳ 2015", "Nhiem ky 2010 - 2015", "nhiệm kỳ 2020 - 2025"]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(terms)], "k int, l array<string>")
    assert [r.s for r in df.orderBy("k").select(ex.tenure(F.col("l")).alias("s")).collect()] == ["٢٠١٥ - ٢٠٢٠", "2010 - 2015"]


def test_totals_nobody_asks_for_are_not_joined(spark):
    from quillspark.operators import dossier as ds

    rows = ds.with_path_facts(spark.createDataFrame([(0, "1/a.pdf", "", "", 1)], "input_ord long, duong_dan_file string, so_van_ban string, nhiem_ky string, n_pages int"))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    every = ds.with_dossier_totals(rows)
    assert joins(every.select("input_ord", "n_pages")) < joins(every)
