"""The three ways from pages to a catalogue: plain, markdown, and by dossier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dossier as ds
from ..operators.extract import extract
from ..sources.tables import style_hints


def _full(pages: str = "pages"):
    """Pages with text, one after the other."""
    return F.array_join(F.filter(pages, lambda p: p != ""), "\n")


def plain(docs: DataFrame) -> DataFrame:
    """(path, pages): fields from the text alone, whether valid or not; files that can't be read give no row."""
    rows = extract(tx.staged(docs.where("pages is not null"), {"_text": _full()}), "_text")
    return rows.withColumn("so_trang_van_ban", F.size("pages").cast("string")).drop("_text")


def markdown(docs: DataFrame) -> DataFrame:
    """(path, pages, bold, upper): lines tagged by style, then fields; only valid documents (EX-12), with their tagged text."""
    tagged = F.array_join(F.transform(tx.split_lines(_full()), lambda l: tx.markdown(l, F.col("bold"), F.col("upper"))), "\n")
    rows = tx.staged(docs.where("pages is not null"), {"markdown_text": tagged})
    return extract(rows, "markdown_text", "bold", "upper").where("is_valid")


def by_dossier(docs: DataFrame) -> DataFrame:
    """(duong_dan_file, input_ord, pages, page_styles): fields with hints from the first two pages, facts from paths, totals of
    dossiers. Documents without text give no row (RO-1)."""
    rows = tx.staged(docs.where("pages is not null"), {"_text": F.array_join("pages", "\n"), "_hints": style_hints(F.col("page_styles")), "n_pages": F.size("pages")})
    rows = rows.where(tx.strip(F.col("_text")) != "").drop("so_ho_so")
    rows = extract(rows, "_text", "_hints", "_hints").drop("_text", "_hints")
    return ds.with_defaults(ds.with_dossier_totals(ds.with_path_facts(rows)))
