"""A query for each operator, over whole driver tables, with DuckDB SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import text as tx
from ..operators import dossier as ds
from ..operators import extract as ex
from ..operators.similar import similar
from ..sources import tables as src
from .corpus import PARTS, RECORDS, TEXTS, duck, parts, records, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = duck(sql)
        return f

    return put


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]|\x{85}|\x{2028}|\x{2029}')"


@query(f"SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(list_sum(list_transform(l, lambda x: length(x))) AS BIGINT) AS n_chars FROM (SELECT doc_id, {_LINES} AS l FROM documents)")
def tx_split_lines(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", tx.split_lines(F.col("text")).alias("l"))
    total = F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), total.alias("n_chars"))


def _replaced(column: str) -> str:
    for a, b in lex.CORRECTIONS.items():
        column = f"replace({column}, '{a}', '{b}')"
    for a, b in (("ngay", "Ngày"), ("thang", "tháng")):
        column = rf"regexp_replace({column}, '(^|[^\p{{L}}\p{{N}}_])(?i:{a})($|[^\p{{L}}\p{{N}}_])', '\1{b}\2', 'g')"
    return column


@query(f"SELECT doc_id, md5({_replaced('text')}) AS corrected_md5, length({_replaced('text')}) AS n_chars FROM documents")
def tx_corrections(spark, sf_dir):
    s = tx.corrected(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(s.cast("binary")).alias("corrected_md5"), F.length(s).cast("long").alias("n_chars"))


@query(rf"SELECT doc_id, CAST(len(list_filter({_LINES}, lambda x: regexp_matches(lower(x), '(^|[^\p{{L}}\p{{N}}_])(page|trang)\s+\d') OR regexp_matches(lower(x), '(^|[^\p{{L}}\p{{N}}_])(admin|scanned by|watermark|logo)($|[^\p{{L}}\p{{N}}_])'))) AS BIGINT) AS n_noise FROM ({TEXTS})")
def tx_noise_filter(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.size(F.filter(tx.split_lines(F.col("text")), tx.is_noise)).cast("long").alias("n_noise"))


_NORMAL = rf"list_filter(list_transform({_LINES}, lambda x: trim(regexp_replace({_replaced('x')}, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(lower(x), '(^|[^\p{{L}}\p{{N}}_])(page|trang)\s+\d'))"


@query(f"SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, md5(array_to_string(l, chr(10))) AS lines_md5 FROM (SELECT doc_id, {_NORMAL} AS l FROM ({TEXTS}))")
def tx_normalize(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", tx.normal_texts(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n").cast("binary")).alias("lines_md5"))


@query(f"SELECT doc_id, array_to_string(l[1:5], '|') AS head, array_to_string(l[greatest(len(l) - 4, 1):], '|') AS tail FROM (SELECT doc_id, {_LINES} AS l FROM documents)")
def ro_head_tail(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", tx.split_lines(F.col("text")).alias("l"))
    return rows.select("doc_id", F.array_join(F.slice("l", 1, 5), "|").alias("head"), F.array_join(F.slice("l", F.greatest(F.size("l") - 4, F.lit(1)), F.lit(5)), "|").alias("tail"))


def _line_rows(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.posexplode(tx.split_lines(F.col("text"))).alias("line_no", "line"))


_LINE_ROWS = f"SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ({TEXTS}))"


@query(f"SELECT doc_id, line_no, line FROM ({_LINE_ROWS}) WHERE line IN ('CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM')")
def tx_motto(spark, sf_dir):
    return _line_rows(spark, sf_dir).where(tx.is_motto(F.col("line"))).withColumn("line_no", F.col("line_no").cast("long"))


@query(rf"SELECT doc_id, line_no, line FROM ({_LINE_ROWS}) WHERE regexp_matches(line, '\p{{L}}') AND upper(line) = line")
def tx_allcaps(spark, sf_dir):
    return _line_rows(spark, sf_dir).where(tx.all_caps(F.col("line"))).withColumn("line_no", F.col("line_no").cast("long"))


@query(rf"SELECT doc_id, line_no FROM ({_LINE_ROWS}) WHERE NOT regexp_matches(line, '(^|\s)[\p{{Ll}}]')")
def tx_titlecase(spark, sf_dir):
    return _line_rows(spark, sf_dir).where(tx.title_case(F.col("line"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query(r"SELECT doc_id, length(b) >= 50 AND length(regexp_replace(b, '[^\p{L}\p{N}]', '', 'g')) / greatest(length(b), 1) >= 0.05 AS dense FROM (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS b FROM documents)")
def tx_density(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.is_dense(F.col("text")).alias("dense"))


@query(rf"SELECT doc_id, upper(regexp_replace(translate(symbol, 'Đđ', 'Dd'), '[^\p{{L}}]', '', 'g')) AS abbreviation FROM ({PARTS})")
def tx_abbr(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", ex.number_symbol(tx.split_lines(F.col("text"))).alias("n"))
    return rows.select("doc_id", tx.abbreviation(F.col("n.symbol")).alias("abbreviation"))


@query(f"SELECT doc_id, array_to_string(CASE WHEN motto IS NULL THEN [agency] ELSE [agency, motto] END, '|') AS header FROM ({PARTS})")
def tx_header_block(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.array_join(tx.header_block(tx.split_lines(F.col("text"))), "|").alias("header"))


@query(f"SELECT doc_id, line_no, CASE WHEN line = upper(line) THEN '# **' || line || '**' WHEN line LIKE 'Số%' THEN '**' || line || '**' ELSE line END AS line FROM ({_LINE_ROWS})")
def tx_markdown(spark, sf_dir):
    rows = _line_rows(spark, sf_dir)
    bold = F.when((F.col("line") == F.upper("line")) | F.col("line").startswith("Số"), F.array(tx.collapse(F.col("line")))).otherwise(F.array().cast("array<string>"))
    upper = F.when(F.col("line") == F.upper("line"), F.array(tx.collapse(F.col("line")))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), tx.markdown(F.col("line"), bold, upper).alias("line"))


@query(f"SELECT doc_id, line_no FROM ({_LINE_ROWS}) WHERE line IN ('UBND TỈNH BẮC GIANG', 'BỘ TÀI CHÍNH', 'SỞ GIÁO DỤC VÀ ĐÀO TẠO', 'CHỦ TỊCH', 'TRẦN THỊ BÌNH')")
def ex_issuer_line(spark, sf_dir):
    return _line_rows(spark, sf_dir).where(tx.is_issuer_line(F.col("line"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query()
def tx_sentence_case(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.sentence_case(tx.merged(tx.split_lines(F.col("text")))).alias("summary"))


def _field(expression):
    def run(spark, sf_dir):
        rows = texts(spark, sf_dir).select("doc_id", tx.normal_texts(F.col("text")).alias("lines"))
        return rows.select("doc_id", *expression(F.col("lines")))

    return run


@query(f"SELECT doc_id, kind AS doc_type FROM ({PARTS})")
def ex_doc_type(spark, sf_dir):
    return _field(lambda l: [ex.doc_type(l, F.lit(None).cast("array<string>"))["type"].alias("doc_type")])(spark, sf_dir)


@query(f"SELECT doc_id, agency FROM ({PARTS})")
def ex_agency(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    return _field(lambda l: [ex.agency(l, none, none, F.lit(-1)).alias("agency")])(spark, sf_dir)


@query(f"SELECT doc_id, number, symbol FROM ({PARTS})")
def ex_number_symbol(spark, sf_dir):
    rows = _field(lambda l: [F.inline(F.array(ex.number_symbol(l)))])(spark, sf_dir)
    return rows.select("doc_id", "number", "symbol")


@query(f"SELECT doc_id, d || '/' || m || '/' || y AS signed_date FROM ({PARTS})")
def ex_date(spark, sf_dir):
    return _field(lambda l: [ex.date(l).alias("signed_date")])(spark, sf_dir)


@query(f"SELECT doc_id, name AS signer FROM ({PARTS})")
def ex_signer(spark, sf_dir):
    return _field(lambda l: [ex.signer(l).alias("signer")])(spark, sf_dir)


@query(f"SELECT doc_id, term AS tenure FROM ({PARTS})")
def ex_tenure(spark, sf_dir):
    return _field(lambda l: [ex.tenure(l).alias("tenure")])(spark, sf_dir)


@query(f"SELECT doc_id, CASE symbol WHEN 'QĐ-UBND' THEN 'ỦY BAN NHÂN DÂN' WHEN 'NQ/ĐUK' THEN 'ĐẢNG ỦY KHỐI CÁC CƠ QUAN VÀ DOANH NGHIỆP TỈNH' ELSE '' END AS body FROM ({PARTS})")
def ex_symbol_issuer(spark, sf_dir):
    return _field(lambda l: [ex.issuer_of_symbol(ex.number_symbol(l)["symbol"]).alias("body")])(spark, sf_dir)


_ABOUT = """CASE WHEN kind <> '' THEN kind || ' Bố' || substr(detail, 3) ELSE 'CÔNG VĂN Về' || substr(subject, 3) END"""


@query(f"""SELECT doc_id, agency AS co_quan_ban_hanh, number AS so_van_ban, symbol AS ky_hieu_van_ban, d || '/' || m || '/' || y AS ngay_ban_hanh,
  CASE WHEN kind <> '' THEN kind ELSE 'CÔNG VĂN' END AS the_loai_van_ban, {_ABOUT} AS trich_yeu_noi_dung, name AS nguoi_ky, term AS nhiem_ky, true AS is_valid FROM ({PARTS})""")
def ex_metadata(spark, sf_dir):
    out = ex.extract(texts(spark, sf_dir))
    return out.select("doc_id", *ex.FIELDS[:8], "is_valid")


@query()
def ex_summary_fallback(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.normal_texts(F.col("text")).alias("lines")).select("doc_id", ex.summary_fallback(F.col("lines")).alias("summary"))


_VALID = "(k <> '' AND (d <> '' OR n <> '')) OR (CAST(k <> '' AS INT) + CAST(d <> '' AS INT) + CAST(n <> '' AS INT) + CAST(length(t) > 50 AS INT)) >= 2"


@query(f"SELECT o_orderkey AS doc_id, {_VALID} AS is_valid FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE '' END AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'B' ELSE '' END AS d, CASE WHEN o_orderkey % 5 = 0 THEN 'C' ELSE '' END AS n, repeat('x', CAST(o_orderkey % 100 AS INT)) AS t FROM orders)")
def ex_validity(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    part = lambda m, x: F.when(F.col("doc_id") % m == 0, F.lit(x)).otherwise(F.lit(""))
    none = F.lit("")
    return o.select("doc_id", ex.is_valid(part(2, "A"), part(3, "B"), part(5, "C"), none, none, none, F.repeat(F.lit("x"), (F.col("doc_id") % 100).cast("int"))).alias("is_valid"))


def _facts(spark, sf_dir):
    return ds.with_path_facts(records(spark, sf_dir).withColumn("nhiem_ky", F.lit("")))


_PATHS = f"""SELECT *, string_split(duong_dan_file, '/') AS p FROM ({RECORDS})"""
_FACTS = rf"""SELECT *, CASE WHEN folder_number <> '' THEN folder_number WHEN two THEN runs[1] WHEN lead <> '' THEN lead ELSE '' END AS so_ho_so,
  CASE WHEN two THEN runs[1] || '_' || runs[len(runs)] WHEN folder_number = '' AND lead <> '' THEN lead WHEN folder_number <> '' THEN folder_number ELSE folder END AS label,
  CASE WHEN so_van_ban = '' AND two THEN runs[len(runs)] ELSE so_van_ban END AS number,
  CASE WHEN duong_dan_file LIKE 'nhiệm kỳ X/%' THEN 'nhiệm kỳ X' WHEN duong_dan_file LIKE 'kho_2010-2018/%' THEN '2010-2018' WHEN duong_dan_file LIKE '2011-2015 luu/%' THEN '2011-2015' ELSE '' END AS nhiem_ky
FROM (SELECT *, regexp_extract(folder, '\d+') AS folder_number, regexp_extract_all(stem, '\d+') AS runs, len(regexp_extract_all(stem, '\d+')) >= 2 AND regexp_matches(stem, '[_-]') AS two,
    CASE WHEN NOT (len(regexp_extract_all(stem, '\d+')) >= 2 AND regexp_matches(stem, '[_-]')) THEN regexp_extract(stem, '^\d\d\d+') ELSE '' END AS lead
  FROM (SELECT *, CASE WHEN len(p) > 1 THEN p[len(p) - 1] ELSE '' END AS folder, replace(p[len(p)], '.pdf', '') AS stem FROM ({_PATHS})))"""


@query(f"SELECT doc_id, so_ho_so, label AS so_va_ky_hieu_ho_so, nhiem_ky FROM ({_FACTS})")
def ex_folder_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("doc_id", "so_ho_so", "so_va_ky_hieu_ho_so", "nhiem_ky")


@query(f"SELECT doc_id, number AS so_van_ban, CASE WHEN two THEN runs[1] ELSE '' END AS so_ho_so_from_filename, CASE WHEN two THEN runs[len(runs)] ELSE '' END AS so_van_ban_from_filename FROM ({_FACTS})")
def ex_filename_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("doc_id", "so_van_ban", "so_ho_so_from_filename", "so_van_ban_from_filename")


_KEYED = f"SELECT *, CASE WHEN so_ho_so <> '' THEN so_ho_so WHEN folder <> '' THEN folder ELSE 'root' END AS key FROM ({_FACTS})"


@query(f"""SELECT doc_id, CAST(docs AS STRING) AS tong_so_van_ban_trong_ho_so, CAST(pages AS STRING) AS so_luong_trang_ho_so,
  CAST(row_number() OVER (PARTITION BY key ORDER BY input_ord) AS STRING) AS muc_luc_so FROM ({_KEYED})
  JOIN (SELECT key, CAST(sum(n) AS BIGINT) AS docs, CAST(sum(p) AS BIGINT) AS pages FROM (SELECT key, duong_dan_file, count(*) AS n, max(n_pages) AS p FROM ({_KEYED}) GROUP BY key, duong_dan_file) GROUP BY key) USING (key)""")
def ro_dossier_agg(spark, sf_dir):
    return ds.with_dossier_totals(_facts(spark, sf_dir)).select("doc_id", "tong_so_van_ban_trong_ho_so", "so_luong_trang_ho_so", "muc_luc_so")


def _catalogue(spark, sf_dir, compat):
    rows = ds.with_defaults(ds.with_dossier_totals(_facts(spark, sf_dir)))
    return ds.catalogue(rows, compat)


_STARTS = """SELECT input_ord + 1 AS "STT", so_ho_so AS "Số hồ sơ", n_pages AS "Số trang",
  CAST(1 + coalesce(sum(n_pages) OVER (PARTITION BY so_ho_so ORDER BY input_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "Trang Số" """


@query(f"{_STARTS} FROM ({_FACTS})")
def ro_start_page(spark, sf_dir):
    return _catalogue(spark, sf_dir, False).select("STT", "Số hồ sơ", "Số trang", "Trang Số")


_BLANK = ", ".join(f"""'' AS "{c}" """ for c in ds.CATALOGUE if c not in ("STT", "Số hồ sơ", "Xem", "Nhiệm kỳ", "Số lượng trang hồ sơ", "Tổng số văn bản trong hồ sơ", "Số văn bản", "Loại văn bản", "Trang Số", "Số trang", "Địa chỉ tài liệu gốc"))


@query(f"""{_STARTS}, '=HYPERLINK("' || duong_dan_file || '", "Xem")' AS "Xem", nhiem_ky AS "Nhiệm kỳ", number AS "Số văn bản", 'bản chính' AS "Loại văn bản", duong_dan_file AS "Địa chỉ tài liệu gốc",
  CAST(pages AS STRING) AS "Số lượng trang hồ sơ", CAST(docs AS STRING) AS "Tổng số văn bản trong hồ sơ", {_BLANK} FROM ({_KEYED})
  JOIN (SELECT key, CAST(sum(n) AS BIGINT) AS docs, CAST(sum(p) AS BIGINT) AS pages FROM (SELECT key, duong_dan_file, count(*) AS n, max(n_pages) AS p FROM ({_KEYED}) GROUP BY key, duong_dan_file) GROUP BY key) USING (key)""")
def sk_catalog26(spark, sf_dir):
    return _catalogue(spark, sf_dir, False)


@query(f"""SELECT "STT", "Số hồ sơ", CAST(1 + coalesce(sum("Số trang") OVER (PARTITION BY "Số hồ sơ" ORDER BY "STT", input_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "Trang Số",
  "Địa chỉ tài liệu gốc" FROM (SELECT input_ord % 1000 + 1 AS "STT", input_ord, so_ho_so AS "Số hồ sơ", n_pages AS "Số trang", duong_dan_file AS "Địa chỉ tài liệu gốc" FROM ({_FACTS}))""")
def sk_catalog26_compat(spark, sf_dir):
    return _catalogue(spark, sf_dir, True).select("STT", "Số hồ sơ", "Trang Số", "Địa chỉ tài liệu gốc")


@query("""SELECT '' AS "Cơ quan ban hành", CASE WHEN so_van_ban <> '' THEN so_van_ban ELSE 'x' || doc_id END AS "Số văn bản", '' AS "Ký hiệu", '' AS "Ngày ký", '' AS "Thể loại văn bản", '' AS "Trích yếu nội dung văn bản",
  '' AS "Người Ký", '' AS "Loại văn bản", '' AS "Trang Số", CAST(n_pages AS STRING) AS "Số trang", duong_dan_file AS "Địa chỉ tài liệu gốc", '' AS "Người nhập tin" FROM (""" + RECORDS + ")")
def sk_cli12(spark, sf_dir):
    rows = records(spark, sf_dir).withColumns({"so_van": F.concat(F.lit("x"), F.col("doc_id").cast("string")), "so_trang": F.col("n_pages")})
    return ds.brief(rows)


@query(f"SELECT doc_id, so_van_ban AS present, CASE WHEN so_van_ban <> '' THEN so_van_ban ELSE 'x' || doc_id END AS truthy FROM ({RECORDS})")
def ro_coalesce(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("so_van", F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    shape = {"n": ("so_van_ban", "so_van")}
    return rows.select("doc_id", ds.shaped(rows, shape, True)["n"].alias("present"), ds.shaped(rows, shape, False)["n"].alias("truthy"))


@query("SELECT '' AS issuer, CAST(o_orderkey AS STRING) AS doc_number, '' AS symbol, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, '') AS signed_date, '' AS doc_type, o_orderpriority AS summary, '' AS signer FROM orders")
def sk_english7(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return ds.english(o.select(F.col("o_orderkey").alias("doc_number"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("signed_date"), F.col("o_orderpriority").alias("summary")))


@query("""SELECT l_orderkey, l_linenumber, CAST(sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 2 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))""")
def ro_islands(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    return ds.islands(rows, ["l_orderkey"], "l_linenumber").withColumn("island", F.col("island").cast("long"))


@query("SELECT c_nationkey, max(c_acctbal) AS best, arg_max(c_name, (c_acctbal, -c_custkey)) AS name FROM customer GROUP BY c_nationkey")
def ro_argmax(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"), F.max_by("c_name", F.struct("c_acctbal", -F.col("c_custkey"))).alias("name"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def ro_semi(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", "source").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ro_anti(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", "source").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left_anti")


@query("SELECT d.doc_id, CASE WHEN e.doc_id IS NOT NULL THEN 'edited' ELSE source END AS source, lang FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) e USING (doc_id)")
def ro_override(spark, sf_dir):
    edits = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").select("doc_id", F.lit("edited").alias("source"), F.lit(None).cast("string").alias("lang")).dropDuplicates(["doc_id"])
    return ds.overridden(_documents(spark, sf_dir).select("doc_id", "source", "lang"), edits, "doc_id")


@query("SELECT conv_id, string_agg(role || ': ' || length(text), ' | ' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def ro_ordered_collect(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.length("text").cast("string")).alias("s"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["s"]), " | ").alias("turns"))


@query()
def ro_similar_topk(spark, sf_dir):
    reference = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("ord"), F.col("item_id").alias("id"), F.col("text").alias("summary"))
    return similar(_documents(spark, sf_dir), reference, "doc_id", "text")


@query("SELECT doc_id, to_json(struct_pack(pages := p)) AS json, array_to_string(p, chr(10) || chr(10) || '--- PAGE SPLIT ---' || chr(10) || chr(10)) AS txt FROM (SELECT doc_id, string_split(name || chr(10) || agency, chr(10)) AS p FROM (" + PARTS + "))")
def sk_pages(spark, sf_dir):
    from ..sources import sinks

    lines = tx.split_lines(F.col("text"))
    rows = texts(spark, sf_dir).select("doc_id", F.array(F.element_at(lines, -1), F.get(lines, F.lit(0))).alias("pages"))
    return rows.select("doc_id", sinks.pages_json().alias("json"), sinks.pages_text().alias("txt"))


@query(f"SELECT doc_id, array_to_string(CASE WHEN n = '' THEN o ELSE [CASE WHEN o[1] <> '' THEN o[1] ELSE n END] END, '|') AS pages FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE name END AS n, CASE WHEN doc_id % 3 = 0 THEN [''] ELSE [agency] END AS o FROM ({PARTS})) WHERE n = '' UNION ALL SELECT doc_id, name FROM ({PARTS}) WHERE doc_id % 2 <> 0")
def sc_recognised(spark, sf_dir):
    lines = tx.split_lines(F.col("text"))
    native = F.array(F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.element_at(lines, -1)))
    seen = F.array(F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.get(lines, F.lit(0))))
    return texts(spark, sf_dir).select("doc_id", F.array_join(src.with_recognised(native, seen), "|").alias("pages"))


# White space as the line operators see it, for SQL whose \\s is ASCII only.
_BLANKS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = rf"'^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g'"


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(replace(replace(array_to_string(list_filter(list_transform({_LINES}, lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> ''), chr(1)), '-' || chr(1), ''), chr(1), ' '),
  '[{_BLANKS}]+', ' ', 'g'), ' ')) AS merged_md5 FROM documents""")
def tx_line_merge(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(tx.merged(tx.split_lines(F.col("text"))).cast("binary")).alias("merged_md5"))


_NAME_WORD = rf"\p{{Lu}}[^{_BLANKS}\p{{Lu}}\p{{Lt}}\p{{Lm}}\p{{Lo}}\p{{Nd}}]*"


@query(rf"""SELECT doc_id, CAST(len(list_filter({_LINES}, lambda x: regexp_matches(x, '^[{_BLANKS}]*{_NAME_WORD}([{_BLANKS}]+{_NAME_WORD}){{1,5}}[{_BLANKS}]*$'))) AS BIGINT) AS n_names FROM documents
  UNION ALL SELECT doc_id, CAST(len(list_filter({_LINES}, lambda x: regexp_matches(x, '^[{_BLANKS}]*{_NAME_WORD}([{_BLANKS}]+{_NAME_WORD}){{1,5}}[{_BLANKS}]*$'))) AS BIGINT) FROM ({TEXTS})""")
def tx_proper_name(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", "text").union(texts(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.size(F.filter(tx.split_lines(F.col("text")), tx.proper_name)).cast("long").alias("n_names"))


#: Lines with markdown by their number: a heading, a bold line, bold words in a line, none.
_MARKED = "CASE line_no % 4 WHEN 0 THEN CONCAT('# ', line) WHEN 1 THEN CONCAT('**', line, '**') WHEN 2 THEN CONCAT('a **', line, '** b') ELSE line END"


@query(f"SELECT doc_id, line_no, CASE line_no % 4 WHEN 2 THEN 'a ' || line || ' b' ELSE line END AS line, line_no % 4 IN (1, 2) AS bold, line_no % 4 = 0 AS heading FROM ({_LINE_ROWS})")
def tx_unmarked(spark, sf_dir):
    rows = _line_rows(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), tx.unmarked(F.expr(_MARKED)).alias("u"))
    return rows.select("doc_id", "line_no", F.col("u.s").alias("line"), "u.bold", "u.heading")


#: Texts with some letters taken apart, dot below before and behind a circumflex or horn.
_APART = "text"
for _a, _b in (("Ế", "E\u0302\u0301"), ("Ị", "I\u0323"), ("ệ", "e\u0323\u0302"), ("ậ", "a\u0302\u0323"), ("ợ", "o\u0323\u031b"), ("ố", "o\u0302\u0301"), ("à", "a\u0300"), ("Ủ", "U\u0309"), ("ễ", "e\u0302\u0303")):
    _APART = f"REPLACE({_APART}, '{_a}', '{_b}')"


@query(f"SELECT doc_id, md5(nfc_normalize({_APART})) AS text_md5 FROM ({TEXTS})")
def tx_composed(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.md5(tx.composed(F.expr(_APART)).cast("binary")).alias("text_md5"))


@query(f"SELECT doc_id, kind AS doc_type, CAST(CASE WHEN kind = '' THEN -1 WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS at FROM ({PARTS})")
def ex_type_excluded(spark, sf_dir):
    """A title's word in a line that can't be one, then the title; a third of the titles are known to be bold."""
    rows = parts(spark, sf_dir)
    lines = F.filter(F.array(F.when(F.col("doc_id") % 2 == 0, F.lit("QUYẾT ĐỊNH CỦA DOANH NGHIỆP")).otherwise(F.lit("")), F.col("kind"), F.col("detail")), lambda x: x != "")
    bold = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("QUYẾT ĐỊNH CỦA DOANH NGHIỆP"), F.col("kind")))
    return rows.select("doc_id", ex.doc_type(lines, bold).alias("t")).select("doc_id", F.col("t.type").alias("doc_type"), F.col("t.at").cast("long").alias("at"))


@query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2005-2010' WHEN 1 THEN '2015-2020' ELSE '' END AS nhiem_ky FROM ({RECORDS})")
def ex_late_tenure(spark, sf_dir):
    folder = F.when(F.col("doc_id") % 3 == 0, "2005 - 2010 x").when(F.col("doc_id") % 3 == 1, "x2015 _2020").otherwise("2015")
    rows = records(spark, sf_dir).withColumn("duong_dan_file", F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    rows = rows.withColumns({c: F.lit("") for c in ("so_ho_so", "so_va_ky_hieu_ho_so", "nhiem_ky")}).withColumn("so_ho_so", (F.col("doc_id") % 4099).cast("string"))
    return ds.with_dossier_totals(rows).select("doc_id", "nhiem_ky")


@query("""SELECT l_orderkey, coalesce(array_to_string(list_sort(list_distinct(flatten(list([CAST(l_suppkey AS STRING), l_returnflag]) FILTER (l_linenumber IN (1, 2))))), '|'), '') AS hints FROM lineitem GROUP BY l_orderkey""")
def ro_set_union(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.flatten(F.collect_set(F.array(F.col("l_suppkey").cast("string"), "l_returnflag"))).alias("lines"))
    pages = rows.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct((F.col("l_linenumber") - 1).cast("int").alias("k"), "lines"))).alias("pages"))
    return pages.select("l_orderkey", F.array_join(F.array_sort(src.style_hints(F.col("pages"))), "|").alias("hints"))


@query(f"SELECT doc_id, '[BLOCK: HEADER_LEFT]' || chr(10) || agency || CASE WHEN motto IS NULL THEN '' ELSE chr(10) || chr(10) || '[BLOCK: HEADER_RIGHT]' || chr(10) || motto END || chr(10) || chr(10) || '[BLOCK: MAIN_BODY]' || chr(10) || detail AS text FROM ({PARTS})")
def sc_blocks(spark, sf_dir):
    block = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("text"))
    blocks = F.array(block("HEADER_LEFT", F.col("agency")), block("HEADER_RIGHT", F.coalesce("motto", F.lit(" "))), block("MAIN_BODY", F.concat(F.lit("\n"), F.col("detail"), F.lit(" "))))
    return parts(spark, sf_dir).select("doc_id", src.block_text(blocks).alias("text"))


@query("SELECT DISTINCT conv_id, turn, coalesce(conv_id IS NOT NULL AND turn % 2 = 0, false) AS known FROM conversations")
def sc_cache(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = [F.col("conv_id").alias("content_hash"), F.col("turn").alias("page_no"), F.lit("e").alias("engine"), F.lit("vie").alias("lang"), F.lit(300).alias("dpi")]
    known, missing = src.cached(c.select(*key).distinct(), c.where("turn % 2 = 0").select(*key, "text"))
    rows = known.select("content_hash", "page_no", F.lit(True).alias("known")).union(missing.select("content_hash", "page_no", F.lit(False)))
    return rows.select(F.col("content_hash").alias("conv_id"), F.col("page_no").alias("turn"), "known")
