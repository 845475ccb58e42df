"""Quality of recognised text against a reference transcription."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMITS = {"char_diff": 5.0, "word_diff": 5.0, "base_similarity": 90.0, "diacritics": 70.0, "overlap": 85.0}
BLANK = r"(?U)[\s\x1c-\x1f]+"


@F.pandas_udf(T.StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)), na_action="ignore")


def letters_and_marks(text: str) -> list[tuple[str, frozenset]]:
    """Each base character with the set of its marks; marks before the first base are dropped."""
    out: list[tuple[str, set]] = []
    for c in unicodedata.normalize("NFD", text):
        if not unicodedata.combining(c):
            out.append((c, set()))
        elif out:
            out[-1][1].add(c)
    return [(b, frozenset(m)) for b, m in out]


def compare(reference: str, hypothesis: str) -> tuple[float, int, float | None]:
    """Similarity of base letters in per cent, how many of them match, and the share of those with the same marks."""
    ref, hyp = letters_and_marks(reference), letters_and_marks(hypothesis)
    m = difflib.SequenceMatcher(None, "".join(b for b, _ in ref), "".join(b for b, _ in hyp))
    same = total = 0
    for op, a, z, b, _ in m.get_opcodes():
        if op == "equal":
            total += z - a
            same += sum(ref[a + k][1] == hyp[b + k][1] for k in range(z - a))
    return 100.0 * m.ratio(), total, round(100.0 * same / total, 2) if total else None


@F.pandas_udf(T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("matched", T.IntegerType()), T.StructField("diacritics", T.DoubleType())]))
def compare_text(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compare(a or "", b or "") for a, b in zip(reference, hypothesis)], columns=["similarity", "matched", "diacritics"])


def words(c: Column) -> Column:
    return F.filter(F.split(c, BLANK), lambda w: w != "")


def difference(reference: Column, hypothesis: Column) -> Column:
    """Difference of two counts in per cent of the reference."""
    return F.round(F.abs(reference - hypothesis) / F.greatest(reference, F.lit(1)).cast("double") * 100, 2)


def content_counts(pairs: DataFrame) -> DataFrame:
    """Adds char_diff and word_diff to rows of reference and hypothesis."""
    ref, hyp = F.col("reference"), F.col("hypothesis")
    return pairs.withColumns({"char_diff": difference(F.length(ref), F.length(hyp)), "word_diff": difference(F.size(words(ref)), F.size(words(hyp)))})


def word_overlap(pairs: DataFrame, plain=strip_diacritics) -> DataFrame:
    """page, overlap: Dice over the multisets of words without marks, in lower case; 100 where both are empty."""
    side = lambda c, name: pairs.select("page", F.explode(words(F.lower(plain(F.col(c))))).alias("word")).groupBy("page", "word").agg(F.count("*").alias(name))
    both = side("reference", "a").join(side("hypothesis", "b"), ["page", "word"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    dice = both.groupBy("page").agg((F.lit(200.0) * F.sum(F.least(a, b)) / F.sum(a + b)).alias("overlap"))
    return pairs.select("page").join(dice, "page", "left").select("page", F.coalesce("overlap", F.lit(100.0)).alias("overlap"))


def verdict(measured: DataFrame, limits: dict | None = None) -> DataFrame:
    """Adds errors, warnings and passed; only base similarity can fail a page."""
    m = LIMITS | (limits or {})
    said = {"char_diff": F.col("char_diff") > m["char_diff"], "word_diff": F.col("word_diff") > m["word_diff"], "diacritics": F.coalesce(F.col("diacritics") < m["diacritics"], F.lit(False)), "overlap": F.col("overlap") < m["overlap"]}
    errors = F.array_compact(F.array(F.when(F.col("similarity") < m["base_similarity"], F.lit("base_similarity"))))
    out = measured.withColumn("errors", errors).withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in said.items()])))
    return out.withColumn("passed", F.size("errors") == 0)


def verify(ocr: DataFrame, reference: DataFrame, limits: dict | None = None) -> DataFrame:
    """One report row for each page that both sides have."""
    pairs = ocr.select("page", F.col("text").alias("hypothesis")).join(reference.select("page", F.col("text").alias("reference")), "page")
    m = content_counts(pairs).withColumn("c", compare_text("reference", "hypothesis")).join(word_overlap(pairs), "page")
    m = m.select("page", "char_diff", "word_diff", "c.similarity", "c.matched", "c.diacritics", "overlap")
    return verdict(m, limits).withColumns({"similarity": F.round("similarity", 2), "overlap": F.round("overlap", 2)})


def missing_reference(ocr: DataFrame, reference: DataFrame) -> DataFrame:
    return ocr.join(reference, "page", "left_anti").select("page")


def summary(reports: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row for a batch; means leave out nulls and are null where there is nothing. skipped: pages without reference, whose names are listed."""
    out = reports.agg(
        F.count("*").alias("pages_evaluated"), F.count_if("passed").alias("pages_passed"), F.count_if(~F.col("passed")).alias("pages_with_errors"),
        F.count_if(F.size("warnings") > 0).alias("pages_with_warnings"), *[F.round(F.avg(c), 2).alias(f"mean_{c}") for c in ("similarity", "diacritics", "overlap")],
    )
    if skipped is None:
        return out
    return out.join(F.broadcast(skipped.agg(F.array_sort(F.collect_list("page")).alias("pages_skipped"))))  # one row on either side


def reports(verified: DataFrame) -> DataFrame:
    """file, report: a page's report as JSON, under the name of its file."""
    m = F.struct(
        F.struct("char_diff", "word_diff").alias("content"), "similarity", F.struct("matched", "diacritics").alias("diacritic_integrity"), "overlap",
    )
    whole = F.struct("page", "passed", m.alias("metrics"), "warnings", "errors")
    return verified.select(F.concat(F.regexp_replace("page", r"(?<=.)\.[^.]*$", ""), F.lit("_report.json")).alias("file"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))


def process_batch(ocr: DataFrame, reference: DataFrame, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Reports of the pages that both sides have, and the batch's summary with the names of those without reference."""
    verified = verify(ocr, reference, limits)
    return reports(verified), summary(verified, missing_reference(ocr, reference))
