"""Sources: folders of PDF files, tables of pages, reference tables, dictionaries, and the cache of recognised pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

REFERENCE = ("id", "ky_hieu", "ngay", "the_loai", "summary")


def pdf_files(spark: SparkSession, path: str | list[str], recursive: bool = True, first: int | None = None, content: bool = False) -> DataFrame:
    """SC-1 to SC-3: (path, modificationTime, length[, content], input_ord) of the PDF files of a folder, in the order of their
    paths, suffixes in any case; of a list of files all must be PDF files. ``first``: only so many (none or 0: all)."""
    if not isinstance(path, str) and (bad := next((p for p in path if not p.lower().endswith(".pdf")), None)):
        raise ValueError(f"{bad} is no PDF file")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.where(F.lower("path").endswith(".pdf")).select("path", "modificationTime", "length", *(["content"] if content else []))
    if first:
        files = files.orderBy("path").limit(first)
    paths = files.select("path")
    # numbers from the sorted list of paths, so that contents aren't moved to be numbered
    numbered = paths.repartitionByRange("path").sortWithinPartitions("path").select("path", F.monotonically_increasing_id().alias("input_ord"))
    return files.join(numbered, "path")


def page_texts(files: DataFrame, read_pages: Callable[[bytes], Iterable[str | None]], first: int | None = 5, total: Callable[[bytes], int] | None = None) -> DataFrame:
    """SC-4: (path, pages) by ``read_pages``, which yields the text of each page of a file; a page for which it yields null
    is ''. Pages behind the ``first`` are '' where ``total`` knows how many there are. A file it can't read has null pages."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages = []
                    for k, t in enumerate(read_pages(content)):
                        if first and k >= first:
                            break
                        pages.append(t or "")
                    out.append((path, pages + [""] * (max(0, total(content) - len(pages)) if total else 0)))
                except Exception:  # noqa: BLE001  any reader's own errors: the file's row says so
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "pages"])

    return files.select("path", "content").mapInPandas(run, "path string, pages array<string>")


def with_recognised(native: Column, recognised: Column, force: bool = False) -> Column:
    """SC-5: recognised text stands in where no page has native text, or by force; page by page if there are as many."""
    none = ~F.exists(F.coalesce(native, F.array().cast("array<string>")), lambda p: F.trim(p) != "")
    both = F.zip_with(recognised, native, lambda o, n: F.when(o != "", o).otherwise(n))
    return F.when(none | F.lit(force), F.when(F.size(recognised) == F.size(native), both).otherwise(F.coalesce(recognised, native))).otherwise(native)


def block_text(blocks: Column) -> Column:
    """SC-7: recognised blocks (array<struct<name, text>>, in reading order) as one text with markers; blank ones are left out."""
    marked = F.transform(F.filter(blocks, lambda b: F.trim(b["text"]) != ""), lambda b: F.concat(F.lit(tx.MARKER), b["name"], F.lit("]\n"), tx.strip(b["text"])))
    return F.array_join(marked, "\n\n")


def cached(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SC-8: (known, missing) of the wanted pages (content_hash, page_no, engine, lang, dpi); known ones with their text."""
    keys = ["content_hash", "page_no", "engine", "lang", "dpi"]
    return wanted.join(cache.select(*keys, "text").dropDuplicates(keys), keys), wanted.join(cache, keys, "left_anti")


def styles(words: DataFrame, pages: int = 3) -> DataFrame:
    """SC-9: (doc_path, page_no, bold, uppercase) lines from word boxes (doc_path, page_no, top, x, text, fontname, size)."""
    rows = words.where(F.col("page_no") < pages).withColumn("row", F.bround("top"))
    is_bold = F.col("fontname").contains("Bold") | F.upper("fontname").contains("BD")
    lines = rows.groupBy("doc_path", "page_no", "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ").alias("line"), F.max(is_bold).alias("bold"), F.avg("size").alias("size")
    )
    lines = lines.withColumn("line", tx.collapse(F.col("line"))).where("line <> ''")
    caps = tx.caps_line(F.col("line")) & ((F.col("size") >= 13.5) | (F.length("line") < 100))
    of = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("line"))))
    return lines.groupBy("doc_path", "page_no").agg(of(F.col("bold")).alias("bold"), of(caps).alias("uppercase"))


def style_hints(page_styles: Column, first: int = 2) -> Column:
    """RO-11: the lines of the first pages of a map page -> lines, each once; null for an unknown map."""
    pages = F.transform(F.array(*map(F.lit, range(first))), lambda k: F.coalesce(F.try_element_at(page_styles, k), F.array().cast("array<string>")))
    return F.when(page_styles.isNotNull(), F.array_distinct(F.flatten(pages)))


def reference_table(spark: SparkSession, path: str) -> DataFrame:
    """SC-12: (ord, id, ky_hieu, ngay, the_loai, summary) of a tab-separated file; blank lines go, cells are trimmed, missing ones ''."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord")).where(tx.strip(F.col("value")) != "")
    cells = F.split("value", "\t")
    return lines.select("ord", *(tx.strip(F.coalesce(F.get(cells, F.lit(k)), F.lit(""))).alias(c) for k, c in enumerate(REFERENCE)))


def dictionaries(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SC-11: name -> (ord, key, value) of a JSON object of objects of strings; an absent file gives none."""
    import json

    try:
        raw = spark.read.text(path, wholetext=True).first()["value"]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return {name: spark.createDataFrame([(k, *p) for k, p in enumerate(d.items())], "ord int, key string, value string") for name, d in json.loads(raw).items()}


def terms(spark: SparkSession, path: str) -> DataFrame:
    """SC-13: the distinct terms of a list."""
    return spark.read.text(path).select(tx.strip(F.col("value")).alias("term")).where("term <> ''").distinct()
