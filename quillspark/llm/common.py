"""Helpers that the operators share: shared staging tables and Arrow batching."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere are runs of characters that are neither space nor U+0009-U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Only a local master, whose executors are the driver, may do without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a staged folder, wherever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def at_exit(f) -> None:
    """Run f when the driver's Python ends."""

    def gone():
        try:
            f()
        except Exception:  # the session may be gone; the cluster then owns what is left
            pass

    atexit.register(gone)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at_exit(lambda: delete(spark, path))
    return path


def staged(df: DataFrame, name: str, files: int | None = None, **options) -> DataFrame:
    """Write df once to the shared folder, in so many files at most, and read it back: lineage ends at files that survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.coalesce(files) if files else df).write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged_: DataFrame) -> None:
    """Remove what staged() or bucketed() wrote, once nothing is read from it any more, and let the driver forget finished shuffles, whose files go too."""
    for df in staged_:
        delete(df.sparkSession, df.staged_at)
    for df in staged_[:1]:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, key: str, name: str, deal: bool = True) -> DataFrame:
    """The same as a table in buckets of key, as many as shuffle partitions, so that joins on key move the other side only.

    deal: shuffle by key first, so that each bucket is one file. Its entry in the catalog goes when the driver's Python ends.
    """
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, name)
    entry = f"quillspark_{name}_{path.rpartition('-')[2]}"
    (df.repartition(n, key) if deal else df).write.option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(entry)
    at_exit(lambda: spark.sql(f"DROP TABLE IF EXISTS {entry}"))
    out = spark.table(entry)
    out.staged_at = path
    return out


def rows(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of Arrow batches of two columns, cut at about limit bytes of text; a null text is empty."""
    for batch in batches:
        texts = batch.column(1)
        start = size = 0
        for i in range(batch.num_rows):
            size += len(texts[i].as_buffer()) if texts[i].is_valid else 0
            if size >= limit or i + 1 == batch.num_rows:
                yield batch.column(0).slice(start, i + 1 - start).to_pylist(), [t or "" for t in texts.slice(start, i + 1 - start).to_pylist()]
                start, size = i + 1, 0


def two(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the key and the text, whatever else the table has."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def own_name(name: str, taken) -> str:
    """A column name that none of taken has, whatever their case."""
    low, name = {t.lower() for t in taken}, "__quill_" + name
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema)
