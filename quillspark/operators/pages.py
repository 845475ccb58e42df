"""Pages of documents: ranges, assembly to Markdown, kind of document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import strip

# What stands before a page, and in the names of files with tables, by language.
TABLES_IN_NAME = {"en": "_tables", "es": "_tablas"}
SEPARATORS = {"en": "--- Page {} ---", "es": "--- Página {} ---"}


def parse_page_range(text: str) -> tuple[int, int]:
    """'A-B' with 1 <= A <= B; ValueError otherwise."""
    parts = text.split("-")
    if len(parts) != 2 or not all(p.strip().isdigit() for p in parts):
        raise ValueError(f"not a page range: {text!r}")
    a, b = map(int, parts)
    if not 1 <= a <= b:
        raise ValueError(f"not a page range: {text!r}")
    return a, b


def page_range(pages: DataFrame, text: str) -> DataFrame:
    return pages.where(F.col("page_number").between(*parse_page_range(text)))


def document_kind(pages: DataFrame, least: int = 80) -> DataFrame:
    """doc_id, kind: digital if the first page has enough text."""
    first = pages.where("page_number = 1")
    return first.select("doc_id", F.when(F.length(strip(F.coalesce("text", F.lit("")))) >= least, "digital").otherwise("scanned").alias("kind"))


def assemble(pages: DataFrame, language: str = "en") -> DataFrame:
    """doc_id, markdown: every page after its separator, in page order."""
    before, after = SEPARATORS[language].split("{}")
    ordered = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    part = lambda p: F.concat(F.lit("\n\n" + before), p["page_number"].cast("string"), F.lit(after + "\n\n"), p["text"])
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, part), "").alias("markdown"))


def numbered(pages: DataFrame, order: str, first_page: int = 1) -> DataFrame:
    """Adds page_number: first_page and on, by each document's order."""
    return pages.withColumn("page_number", F.row_number().over(W.partitionBy("doc_id").orderBy(order)) + F.lit(first_page - 1))


def output_name(stem: Column, page_range: tuple[int, int] | None = None, tables: bool = False, language: str = "en") -> Column:
    """The name of a document's Markdown file: its stem, the pages and whether tables are in it."""
    return F.concat(stem, F.lit((f"_pp{page_range[0]}-{page_range[1]}" if page_range else "") + (TABLES_IN_NAME[language] if tables else "") + ".md"))
