"""Correction of a stream of pages: stateless, so the batch expressions serve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import fix_text


def corrected(stream: DataFrame, mode: str = "full") -> DataFrame:
    return stream.withColumn("text", fix_text(F.col("text"), mode))
