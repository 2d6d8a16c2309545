"""Dossiers: facts from paths, totals, running numbers, and the catalogue's record shapes.

Records come with ``duong_dan_file`` (path under the base folder, '/'-separated), ``input_ord`` (their place in the input,
from 0) and ``n_pages``. Input order is always this column; nothing depends on how Spark happens to hold the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .prefix import running

# The catalogue's columns, and the record fields each may come from.
CATALOGUE = {
    "STT": (), "Tiêu đề hồ sơ": ("tieu_de", "tieu_de_ho_so"), "Số hồ sơ": ("so_ho_so",), "Thời gian bắt đầu": ("thoi_gian_bat_dau", "tu_ngay"),
    "Thời gian kết thúc": ("thoi_gian_ket_thuc", "den_ngay"), "Số lượng tờ": ("so_to", "so_luong_to"), "Thời hạn bảo quản": ("thoi_han_bao_quan", "thoi_han"),
    "Tên phông": ("ten_phong",), "Mã phông": ("ma_phong",), "Hộp Số": ("hop_so", "hop"), "Số lượng trang hồ sơ": ("so_trang", "so_trang_hs"),
    "Tổng số văn bản trong hồ sơ": ("tong_so_van_ban", "tong_so"), "Xem": ("xem_file",), "Nhiệm kỳ": ("nhiem_ky",), "Cơ quan ban hành": ("co_quan_ban_hanh", "co_quan"),
    "Số văn bản": ("so_van_ban", "so_van"), "Ký hiệu": ("ky_hieu_van_ban", "ky_hieu"), "Ngày ký": ("ngay_ky", "ngay"), "Thể loại văn bản": ("the_loai_van_ban", "the_loai"),
    "Trích yếu nội dung văn bản": ("trich_yeu_noi_dung", "trich_yeu"), "Người Ký": ("nguoi_ky",), "Loại văn bản": ("loai_ban", "loai_van_ban"),
    "Trang Số": ("trang_so", "trang_bat_dau"), "Số trang": ("so_trang_van_ban", "so_trang"), "Địa chỉ tài liệu gốc": ("dia_chi_tai_lieu", "duong_dan_file", "duong_dan"),
    "Người nhập tin": ("nguoi_nhap_tin", "nguoi_nhap"),
}
#: Where the extractor's names differ from those the catalogue looks for.
WIRED = {"Số lượng trang hồ sơ": ("so_luong_trang_ho_so",), "Tổng số văn bản trong hồ sơ": ("tong_so_van_ban_trong_ho_so",)}

# The command line's columns.
BRIEF = {
    "Cơ quan ban hành": ("co_quan_ban_hanh", "co_quan"), "Số văn bản": ("so_van_ban", "so_van"), "Ký hiệu": ("ky_hieu_van_ban", "ky_hieu"),
    "Ngày ký": ("ngay_ky", "ngay"), "Thể loại văn bản": ("the_loai_van_ban",), "Trích yếu nội dung văn bản": ("trich_yeu_noi_dung", "trich_yeu"),
    "Người Ký": ("nguoi_ky",), "Loại văn bản": ("loai_ban", "loai_van_ban"), "Trang Số": ("trang_so",), "Số trang": ("so_trang_van_ban", "so_trang"),
    "Địa chỉ tài liệu gốc": ("dia_chi_tai_lieu_goc", "duong_dan", "duong_dan_file"), "Người nhập tin": (),
}
ENGLISH = ("issuer", "doc_number", "symbol", "signed_date", "doc_type", "summary", "signer")


def folder_facts(folder: Column) -> Column:
    """EX-13: struct(dossier, label) of a file's folder name."""
    digits = F.regexp_extract(folder, r"(\d+)", 1)
    return F.struct(F.when(digits != "", digits).alias("dossier"), F.when(folder != "", F.when(digits != "", digits).otherwise(folder)).alias("label"))


def folder_tenure(folders: Column) -> Column:
    """EX-14: the term of office in folder names, the deepest first; null without."""

    def one(f: Column) -> Column:
        y = lambda g: F.regexp_extract(f, r"(\d{4})[-_](\d{4})", g).try_cast("int")
        named = tx.collapse(F.lower(f)).rlike("nhiem ky|nhiệm kỳ")
        return F.when(named, f).when(y(1).between(1900, 2100) & y(2).between(1900, 2100), F.concat_ws("-", y(1).cast("string"), y(2).cast("string")))

    return F.get(F.filter(F.transform(F.reverse(folders), one), lambda x: x.isNotNull()), F.lit(0))


def filename_facts(name: Column) -> Column:
    """EX-15: struct(first, last, leading) of the digit runs in a file name; null where they say nothing."""
    stem = tx.stem(name)
    runs = F.regexp_extract_all(stem, F.lit(r"(\d+)"), F.lit(1))
    two = (F.size(runs) >= 2) & stem.rlike("[_-]")
    lead = F.regexp_extract(stem, r"^(\d{3,})", 1)
    return F.struct(F.when(two, F.get(runs, F.lit(0))).alias("first"), F.when(two, F.element_at(runs, -1)).alias("last"), F.when(~two & (lead != ""), lead).alias("leading"))


def with_path_facts(records: DataFrame, path: str = "duong_dan_file") -> DataFrame:
    """EX-13 to EX-15, TX-22: dossier number and label, term, number and link from the path."""
    folders = F.filter(F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/"), lambda f: f != "")
    out = records.withColumns({"_folder": folder_facts(tx.parent_folder(F.col(path))), "_file": filename_facts(F.substring_index(path, "/", -1)), "_term": folder_tenure(folders)})
    return out.withColumns({
        "so_ho_so": tx.truthy(F.col("_folder.dossier"), F.col("_file.first"), F.col("_file.leading")),
        "so_va_ky_hieu_ho_so": F.coalesce(F.when(F.col("_file.first").isNotNull(), F.concat_ws("_", "_file.first", "_file.last")), F.when(F.col("_folder.dossier").isNull(), F.col("_file.leading")), F.col("_folder.label"), F.lit("")),
        "so_van_ban": tx.truthy(F.col("so_van_ban"), F.col("_file.last")),
        "so_ho_so_from_filename": F.coalesce("_file.first", F.lit("")), "so_van_ban_from_filename": F.coalesce("_file.last", F.lit("")),
        "nhiem_ky": F.coalesce("_term", "nhiem_ky", F.lit("")), "xem_file": tx.hyperlink(F.col(path)),
    }).drop("_folder", "_file", "_term")


def dossier_key(path: str = "duong_dan_file") -> Column:
    return F.coalesce(F.nullif("so_ho_so", F.lit("")), F.nullif(tx.parent_folder(F.col(path)), F.lit("")), F.lit("root"))


def with_dossier_totals(records: DataFrame, path: str = "duong_dan_file") -> DataFrame:
    """RO-3, RO-4, EX-16: documents and pages (each file once) of the dossier, and the running number in it."""
    rows = records.withColumn("_key", dossier_key(path))
    once = rows.groupBy("_key", path).agg(F.count("*").alias("n"), F.max("n_pages").alias("p"))
    totals = once.groupBy(F.col("_key").alias("_k")).agg(F.sum("n").alias("_docs"), F.sum(F.coalesce("p", F.lit(0))).alias("_pages"))
    rows = running(rows, ["_key"], "input_ord", {"_before": F.lit(1)}).join(totals, F.col("_key") == F.col("_k"), "left")  # each key has totals; a plan that needs none drops the join
    late = F.regexp_extract(tx.parent_folder(F.col(path)), r"(?U)(20\d{2})\s*[-_/]\s*(20\d{2})", 1)
    until = F.regexp_extract(tx.parent_folder(F.col(path)), r"(?U)(20\d{2})\s*[-_/]\s*(20\d{2})", 2)
    text = lambda c: c.cast("long").cast("string")
    return rows.withColumns({
        "so_luong_trang_ho_so": text(F.col("_pages")), "tong_so_van_ban_trong_ho_so": text(F.col("_docs")), "muc_luc_so": text(F.col("_before") + 1),
        "dia_chi_tai_lieu_goc": F.col(path), "so_trang_van_ban": text(F.col("n_pages")),
        "so_va_ky_hieu_ho_so": tx.truthy(F.col("so_va_ky_hieu_ho_so"), tx.parent_folder(F.col(path))),
        "nhiem_ky": tx.truthy(F.col("nhiem_ky"), F.when(late != "", F.concat_ws("-", late, until))),
    }).drop("_key", "_k", "_docs", "_pages", "_before")


def with_defaults(records: DataFrame) -> DataFrame:
    """EX-17."""
    have = set(records.columns)
    return records.withColumns({"loai_ban": F.coalesce("loai_ban", F.lit("bản chính")) if "loai_ban" in have else F.lit("bản chính"), "con_dau": F.coalesce("con_dau", F.lit("")) if "con_dau" in have else F.lit("")})


def overridden(records: DataFrame, edits: DataFrame, key: str = "duong_dan_file") -> DataFrame:
    """RO-9: fields of ``edits`` that are not null replace those of the records with the same key; one edit a key."""
    fields = [c for c in edits.columns if c != key and c in records.columns]
    edits = edits.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in fields))
    joined = records.join(edits, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in records.columns))


def shaped(records: DataFrame, shape: dict[str, tuple[str, ...]], empty_blocks: bool) -> dict[str, Column]:
    """RO-16 (``empty_blocks``: the first field that is there and not null, be it '') or RO-17 (the first that is not '')."""
    have = set(records.columns)
    out = {}
    for name, fields in shape.items():
        found = [F.col(f).cast("string") for f in fields if f in have]
        out[name] = F.coalesce(*found, F.lit("")) if empty_blocks else tx.truthy(*found)
    return out


def catalogue(records: DataFrame, compat: bool = False, batch: int = 1000) -> DataFrame:
    """The 26 columns (RO-5, RO-6, RO-16, RO-21, RO-22): pages as numbers, start pages from the pages before in the dossier.
    Rows carry ``STT``, their place in the input from 1; order by (Số hồ sơ, STT) to print them.

    ``compat``: numbers start anew every ``batch`` rows and dossier totals stay blank, as in the program this replaces."""
    shape = CATALOGUE if compat else CATALOGUE | WIRED
    cols = shaped(records, shape, True)
    cols["STT"] = (F.col("input_ord") % batch + 1 if compat else F.col("input_ord") + 1).cast("long")
    cols["Số trang"] = F.coalesce(cols["Số trang"].try_cast("double").cast("long"), F.lit(0))
    rows = records.select("input_ord", *(c.alias(n) for n, c in cols.items()))
    # in compat, rows of equal number stay in input order
    order = F.col("STT") * F.lit(1 << 32) + F.col("input_ord") if compat else F.col("STT")
    out = running(rows.withColumn("_order", order), ["Số hồ sơ"], "_order", {"_before": F.col("Số trang")}, (1 << 32) * batch if compat else 1 << 16)
    return out.withColumn("Trang Số", (F.col("_before") + 1).cast("long")).select(*CATALOGUE)


def brief(records: DataFrame) -> DataFrame:
    """The 12 columns of the command line (RO-17)."""
    return records.select(*(c.alias(n) for n, c in shaped(records, BRIEF, False).items()))


def english(records: DataFrame) -> DataFrame:
    """The 7 English columns (SK-3)."""
    have = set(records.columns)
    return records.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in ENGLISH))


def islands(rows: DataFrame, keys: list[str], at: str, gap: int = 2) -> DataFrame:
    """RO-13: ``rows`` with ``island``, the number from 1 of the run of places at most ``gap`` apart."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) <= F.lag(at).over(w) + gap, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
