"""A corpus of administrative documents made from the star schema, by SQL that Spark and DuckDB read alike.

An order is a document, its customer the dossier, its line items the pages. Which lines a document has follows from remainders
of its key, so that what the extractors must find is known from the same remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTS = """
SELECT o_orderkey AS doc_id, o_custkey AS dossier_id, CAST(coalesce(n, 0) AS BIGINT) AS n_pages,
  CASE o_custkey % 3 WHEN 0 THEN 'UBND TỈNH BẮC GIANG' WHEN 1 THEN 'BỘ TÀI CHÍNH' ELSE 'SỞ GIÁO DỤC VÀ ĐÀO TẠO' END AS agency,
  CASE WHEN o_orderkey % 4 = 1 THEN 'CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM' END AS motto,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Trang 3' ELSE 'Phòng Hành  chính' END AS office,
  CAST(o_orderkey % 1000 AS STRING) AS number,
  CASE o_orderkey % 3 WHEN 0 THEN 'QĐ-UBND' WHEN 1 THEN 'NQ/ĐUK' ELSE '' END AS symbol,
  CASE o_orderkey % 3 WHEN 0 THEN '/QĐ-UBND' WHEN 1 THEN ' - NQ/ĐUK' ELSE '' END AS symbol_text,
  LPAD(CAST(DAY(o_orderdate) AS STRING), 2, '0') AS d, LPAD(CAST(MONTH(o_orderdate) AS STRING), 2, '0') AS m, CAST(YEAR(o_orderdate) AS STRING) AS y,
  CASE o_orderkey % 4 WHEN 0 THEN 'QUYẾT ĐỊNH' WHEN 1 THEN 'KẾ HOẠCH' WHEN 2 THEN 'TỜ TRÌNH' ELSE '' END AS kind,
  CASE WHEN o_orderkey % 4 = 3 THEN 'Về việc tăng cường quản lý ngân sách nhà nước trên địa bàn' END AS subject,
  CONCAT('bố trí kinh phí đợt ', CAST(o_orderkey % 9 AS STRING), ' cho các đơn vị') AS detail,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Khóa V, nhiệm kỳ 2015 - 2020' END AS term_text,
  CASE WHEN o_orderkey % 6 = 0 THEN '2015 - 2020' ELSE '' END AS term,
  CASE o_custkey % 2 WHEN 0 THEN 'Nguyễn Văn An' ELSE 'TRẦN THỊ BÌNH' END AS name
FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) AS p ON o_orderkey = l_orderkey
"""

TEXTS = f"""
SELECT doc_id, dossier_id, n_pages, CONCAT_WS(CHR(10), agency, motto, office, CONCAT('Số: ', number, symbol_text),
  CONCAT('Hà Nội, ngày ', d, ' tháng ', m, ' năm ', y), CASE WHEN kind <> '' THEN kind END, subject, detail,
  'Căn cứ Luật ban hành ngày 01 tháng 02 năm 2003;', term_text, 'CHỦ TỊCH', name) AS text FROM ({PARTS}) AS parts
"""

#: Documents as catalogue records: a path of a few kinds, and the place in the input.
RECORDS = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY stretch ORDER BY doc_id) - 1 + before AS BIGINT) AS input_ord, n_pages, so_van_ban, path AS duong_dan_file FROM (
  SELECT doc_id, n_pages, CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(doc_id % 1000 AS STRING) END AS so_van_ban, CAST(floor(doc_id / 4096) AS BIGINT) AS s,
    CASE dossier_id % 4 WHEN 0 THEN CONCAT('nhiệm kỳ X/', CAST(dossier_id AS STRING), '/', CAST(doc_id AS STRING), '.pdf')
      WHEN 1 THEN CONCAT('kho_2010-2018/HS', CAST(dossier_id AS STRING), '/', CAST(dossier_id AS STRING), '_', CAST(doc_id AS STRING), '.pdf')
      WHEN 2 THEN CONCAT('2011-2015 luu/', CAST(100 + dossier_id AS STRING), '.pdf') ELSE CONCAT(CAST(doc_id AS STRING), '-a.pdf') END AS path
  FROM (SELECT o_orderkey AS doc_id, o_custkey AS dossier_id, CAST(coalesce(n, 0) AS BIGINT) AS n_pages FROM {orders}
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) AS p ON o_orderkey = l_orderkey) AS d
) AS r JOIN (SELECT stretch, CAST(coalesce(sum(k) OVER (ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM (SELECT CAST(floor(o_orderkey / 4096) AS BIGINT) AS stretch, count(*) AS k FROM {orders} GROUP BY CAST(floor(o_orderkey / 4096) AS BIGINT)) AS c) AS b ON s = stretch
"""


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Few bytes of keys become much text to work on: orders are dealt to all cores, however few splits their file has."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")}
    return tables | {"orders": tables["orders"].repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey")}


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dossier_id, n_pages, text)."""
    return spark.sql(TEXTS, **_tables(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the texts are made of, a column each."""
    return spark.sql(PARTS, **_tables(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, input_ord, n_pages, so_van_ban, duong_dan_file)."""
    return spark.sql(RECORDS, **_tables(spark, sf_dir))


def duck(sql: str) -> str:
    return sql.replace("{orders}", "orders").replace("{lineitem}", "lineitem")
