"""Sources and sinks: text folders, word-processor files, issue dumps; Markdown and JSON."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.rules import PRIVATE_USE


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """page, text: each file whole, page being its name. Order by page where the order counts."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.col("value").alias("text"))


def issues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def provided_pages(documents: DataFrame, provider: Callable[[bytes, str], Iterator[tuple[int, str]]]) -> DataFrame:
    """doc_id, page_number, text of binary files, by any engine that turns (content, path) into pages; a page at a time leaves the worker."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for n, text in provider(content, path):
                    yield pd.DataFrame({"doc_id": [path.rpartition("/")[2].rpartition(".")[0]], "page_number": [n], "text": [text]})

    return documents.select("path", "content").mapInPandas(run, "doc_id string, page_number int, text string")


# What a page provider is told to look for in documents with text, as ruled lines make the tables there.
LINE_SETTINGS = {"vertical_strategy": "lines", "horizontal_strategy": "lines", "snap_tolerance": 5, "join_tolerance": 3, "edge_min_length": 30, "min_words_vertical": 1, "min_words_horizontal": 1}


def provided_grids(documents: DataFrame, provider: Callable[[bytes, str, dict], Iterator[tuple[int, list[list[list[str | None]]]]]], settings: dict = LINE_SETTINGS) -> DataFrame:
    """doc_id, page_number, table_ord, grid of binary files, by any engine that turns (content, path, settings) into pages of tables."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for n, found in provider(content, path, settings):
                    for k, grid in enumerate(found, 1):
                        yield pd.DataFrame({"doc_id": [path.rpartition("/")[2].rpartition(".")[0]], "page_number": [n], "table_ord": [k], "grid": [grid]})

    return documents.select("path", "content").mapInPandas(run, "doc_id string, page_number int, table_ord int, grid array<array<string>>")


# The parts of a word-processor file, and the namespace of their elements.
PARTS = {"body": "word/document.xml", "footnotes": "word/footnotes.xml", "endnotes": "word/endnotes.xml"}


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in PARTS]))
def docx_parts(content: pd.Series) -> pd.DataFrame:
    """The parts' text; empty where the file has no such part, null where there is no file."""

    def one(raw):
        if raw is None:
            return [None] * len(PARTS)
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            have = set(z.namelist())
            return [z.read(p).decode("utf-8") if p in have else "" for p in PARTS.values()]

    return pd.DataFrame([one(c) for c in content], columns=list(PARTS), dtype=object)


def _root(xml: str) -> ElementTree.Element:
    """The part's tree; a part without a declared namespace is read as if it had declared the usual one."""
    if "xmlns:w=" not in xml:
        xml = re.sub(r"^\s*<\?xml.*?\?>", "", xml, flags=re.S)
        xml = f'<part xmlns:w="{W[1:-1]}">{xml}</part>'
    return ElementTree.fromstring(xml)


def _paragraphs(root: ElementTree.Element, known: dict[str, dict[str, str]]) -> list[str]:
    """Each paragraph's runs of text, in order; a reference to a known note stands as the note in brackets."""
    out: list[list[str]] = []

    def walk(node, inside: bool):
        for x in node:
            if x.tag == W + "p" and not inside:
                out.append([])
                walk(x, True)
                continue
            if inside and x.tag == W + "t":
                out[-1].append("".join(x.itertext()))
            elif inside and (note := known.get(x.tag, {}).get(x.get(W + "id", ""))):
                out[-1].append(f" [{note}] ")
            else:
                walk(x, inside)

    walk(root, root.tag == W + "p")
    return ["".join(p) for p in out]


def paragraphs(xml: str) -> list[str]:
    return _paragraphs(_root(xml), {}) if xml.strip() else []


def notes(xml: str, kind: str) -> dict[str, str]:
    """Text of each note by id, its paragraphs trimmed and joined; but for the two that separate notes from the page."""
    if not xml.strip():
        return {}
    found = ((x.get(W + "id"), (p.strip() for p in _paragraphs(x, {}))) for x in _root(xml).iter(W + kind))
    return {i: " ".join(p for p in some if p) for i, some in found if i not in (None, "-1", "0")}


def docx_text(body: str, footnotes: str, endnotes: str) -> str:
    """Paragraphs by line, each note in brackets where it is referred to, letters of private use resolved."""
    known = {W + kind + "Reference": notes(xml, kind) for kind, xml in (("footnote", footnotes), ("endnote", endnotes))}
    text = "\n".join(_paragraphs(_root(body), known)) if body.strip() else ""
    for old, new in PRIVATE_USE:
        text = text.replace(old, new)
    return text


@F.pandas_udf(T.StringType())
def docx_text_udf(parts: pd.DataFrame) -> pd.Series:
    return pd.Series([None if x[0] is None else docx_text(*x) for x in zip(parts["body"], parts["footnotes"], parts["endnotes"])], dtype=object)


def write_texts(texts: DataFrame, path: str, name: str = "file", value: str = "text") -> None:
    """A folder for each name, with the text as it is: Markdown under its output_name, a page's report, the text of a word-processor file."""
    texts.select(F.col(name).alias("file"), F.col(value).cast("string").alias("value")).write.partitionBy("file").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The batch's one row as JSON."""
    summary.coalesce(1).write.json(path, ignoreNullFields=False)
