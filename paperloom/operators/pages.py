"""Page tables: repeated headers and footers, native pages, and pages joined into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T


def repeated_lines(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, line) that stand first or last on at least ceil(share * pages) pages of documents with three pages or more."""
    rows = pages.withColumn("lines", F.split(T.trim(F.col("text")), "\n"))
    first, last = T.trim(F.element_at("lines", 1)), T.trim(F.element_at("lines", -1))
    ends = F.when(F.size("lines") > 1, F.array(first, last)).otherwise(F.array(first))
    rows = rows.select("doc_id", "page_no", F.explode(ends).alias("line")).where("line <> ''")
    counts = rows.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return counts.join(total, "doc_id").where((F.col("pages") > 2) & (F.col("n") >= F.ceil(F.col("pages") * share))).select("doc_id", "line")


def strip_repeated(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, page_no, text) without repeated lines, wherever they stand."""
    rows = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("key", T.trim(F.col("line")))
    kept = rows.join(repeated_lines(pages, share).withColumnRenamed("line", "key"), ["doc_id", "key"], "left_anti")
    kept = kept.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select("doc_id", "page_no").join(kept, ["doc_id", "page_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of each document in order, with a blank line between them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"])
    return pages.groupBy("doc_id").agg(T.trim(F.array_join(ordered, "\n\n")).alias("text"))


def strategy(pages: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, pages, native_pages, strategy): a page with so many inked characters needs no recognition."""
    native = F.length(T.ink(F.coalesce("text", F.lit("")))) >= least
    out = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(native).alias("native_pages"))
    return out.withColumn("strategy", F.when(F.col("native_pages") == F.col("pages"), "native").when(F.col("native_pages") == 0, "scanned").otherwise("mixed"))
