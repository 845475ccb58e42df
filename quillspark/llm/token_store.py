"""Operator 2, token-id output: ORC files with run-length encoded ids, row indexes and Bloom filters on document ids.

The files are in ascending doc_id order, within a file and from file to file, so that a range of ids prunes files by footer and
stripes by index, and the Bloom filter prunes stripes for single ids. Every document ends with id 0. Null text is empty: just the end
id. Rows with a null doc_id come first. Rows with equal or null ids stay separate, lie side by side in the order in which the table was
read, and may be dealt out over several files, so that no id fills one task. An empty table gives no rows.

What is read back is summed in the files' own order: each split of a file by itself, and then the splits' totals, one row a split.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.bpe import WordIds, default_vocabulary
from quillspark.llm.common import new_path, rows, staged, two

END = 0
STRIPE = 16 << 20
SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_tables: dict[str, WordIds] = {}


def _encoded(path: str):
    def run(batches):
        table = _tables.setdefault(path, WordIds(path))  # lives as long as the worker; bounded
        for doc_ids, texts in rows(batches):
            parts, ends, done = [], np.zeros(len(texts) + 1, np.int32), 0
            for k, t in enumerate(texts):
                ids = table.bpe.whole(t)
                parts += [np.array(ids, np.int32) if ids is not None else table.encode([t])[0], np.array([END], np.int32)]
                done += len(parts[-2]) + 1
                ends[k + 1] = done
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), pa.int32()))], schema=SCHEMA)

    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None, partitions: int | None = None) -> None:
    """Write the ids of every document to ORC files under path, in ascending doc_id order. partitions: how many files, as many as
    spark.sql.shuffle.partitions unless given."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = two(docs).withColumn("place", F.monotonically_increasing_id())  # parts equal ids, without a look at the text
    ordered = placed.repartitionByRange(n, "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")  # what is sorted is text: it is encoded after
    ordered.mapInArrow(_encoded(vocabulary or default_vocabulary()), "doc_id long, ids array<int>").write.options(
        **{"orc.compress": "ZSTD", "orc.stripe.size": STRIPE, "orc.row.index.stride": 1000, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}
    ).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of a folder that write() made; filters on doc_id reach the stripes' indexes and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files, which are read once."""

    def run(batches):
        now, done = None, 0  # the split that is read, and its ids so far
        for b in batches:
            file, block, key, lists = b.columns
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            places = list(zip(file.to_pylist(), block.to_pylist()))
            n = np.diff(at).astype(np.int64)
            crc, inner = [zlib.crc32(flat[s:e].data) for s, e in zip(at[:-1].tolist(), at[1:].tolist())], []
            for place, k in zip(places, n.tolist()):
                if place != now:
                    now, done = place, 0
                inner.append(done)
                done += k
            yield pa.RecordBatch.from_arrays([file, block, key, pa.array(inner, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["file", "block", "doc_id", "inner", "n_tokens", "ids_crc32"])

    # the file's name begins with its number among the ordered partitions; a task reads a split's rows in order
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("file")
    each = staged(stored.select(number, F.col("_metadata.file_block_start").alias("block"), "doc_id", "ids").mapInArrow(run, "file int, block long, doc_id long, inner long, n_tokens long, ids_crc32 long"), "digests")
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    splits = each.groupBy("file", "block").agg(F.sum("n_tokens").alias("total")).select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return each.join(splits, ["file", "block"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def stored_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write, then read back and digest."""
    spark = docs.sparkSession
    write(docs, path := new_path(spark, "tokens"), vocabulary)
    return digests(read(spark, path))
