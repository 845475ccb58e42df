"""Operator 8, mixing sources to target weights: weighted fair queueing.

A document's size is its number of words. Sources in order of code points, null last, weigh 5, 2, 1, 5, 2, 1, ...; they share all words
by weight, but none gets more than three times what it has, and what is over goes to the others by weight. Each source
queues its documents in up to three rounds, shuffled anew in each round by a hash of round, id and text. A queued copy's virtual finish time
is its source's words up to and with it, divided by the source's target; all copies are put in order of that time and taken while the total
stays within the budget, which is the sum of the targets. A copy that would go beyond is not taken, nor any after it.

Running sums are made over buckets of the sort key: sums of buckets first, then within each bucket. No task holds a source or
the whole queue, so one source may hold any share. Bins of virtual time end at LAST_BIN; what lies beyond the budget, as most of a large source
of low weight does, isn't summed. Documents without words have size 0 and take 0. Rows with equal or null
ids are shuffled by their texts, so they lie in many buckets; rows equal in both are queued one after the other, in the order in which the table was
read. An empty table gives an empty result. Sizes taken depend on ids and texts alone: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, own_name, staged

WEIGHTS, MOST = (5, 2, 1), 3
DIGITS, BINS, LAST_BIN, IDLE = 3, 2048, 8191, 4096  # hexadecimal digits of a bucket of the shuffle; bins of virtual time; parts of what is never taken


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of (source, size) rows: one row a source, so its windows hold as many rows as there are sources.

    In order of cap / weight, a source is within its cap if its share of what the earlier ones' caps leave is; from the first such
    source on all are, and that source's level holds for all of them.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")))
    cap, weight = MOST * F.col("source_size"), F.col("weight")
    by_cap = W.orderBy(cap / weight, F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    each = each.withColumn("share", F.sum("weight").over(after)).withColumn("rest", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    held = F.max(F.when(F.col("rest") * weight <= cap * F.col("share"), F.struct("share", "rest"))).over(W.partitionBy())
    level = each.withColumn("level", held)
    return level.select("source", "source_size", F.least(cap.cast("double"), weight * F.col("level.rest") / F.col("level.share")).alias("target"))


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, source, size, digest (of the text): written once, so that the text is read once and rows keep their numbers. row: the column that has them already."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), 1, 16)
    return staged(docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), digest.alias("digest")), "sizes")


def queue(sizes: DataFrame) -> DataFrame:
    """Every queued copy: the columns of sizes, source_size, target, round, and whether it is taken."""
    goals = staged(targets(sizes), "targets")  # one row a source
    d = sizes.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left").select("s.*", "g.source_size", "g.target")
    rounds = F.filter(F.array(*[F.lit(k) for k in range(MOST)]), lambda k: (k == 0) | (k * F.col("source_size") < F.col("target")))
    d = d.withColumn("round", F.explode(rounds))
    d = d.withColumn("draw", F.md5(F.concat_ws(":", F.col("round").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest")))
    d = d.withColumn("bucket", F.substring("draw", 1, DIGITS))
    lists = d.groupBy("source", "round", "bucket").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("round", "bucket").rowsBetween(W.unboundedPreceding, -1)
    lists = lists.withColumn("base", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    own = W.partitionBy("source", "round", "bucket").orderBy("draw", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("cum", F.sum("size").over(own)).alias("d").join(
        lists.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.round") == F.col("l.round")) & (F.col("d.bucket") == F.col("l.bucket")), "left"
    ).select("d.*", (F.col("d.cum") + F.col("l.base")).alias("served"))
    d = d.withColumn("finish", F.coalesce(F.try_divide(F.col("served").cast("double"), F.col("target")), F.lit(0.0)))
    d = d.withColumn("bin", F.least(F.floor(F.col("finish") * BINS), F.lit(LAST_BIN)).cast("int"))
    bins = d.groupBy("bin").agg(F.sum("size").alias("words"))  # at most LAST_BIN + 1 rows
    bins = bins.withColumn("earlier", F.coalesce(F.sum("words").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    bins = bins.drop("words")
    total = goals.agg(F.sum("source_size").alias("budget")).collect()[0]["budget"] or 0  # a single number
    # a copy in a bin beyond the budget, or without words, isn't taken whatever its place: it needs no running sum and is dealt out evenly
    d = d.join(F.broadcast(bins), "bin").withColumn("part", F.when((F.col("size") > 0) & (F.col("earlier") < total), F.col("bin")).otherwise(-1 - F.pmod(F.xxhash64("row"), F.lit(IDLE)).cast("int")))
    mine = W.partitionBy("part").orderBy("finish", F.col("source").asc_nulls_last(), "draw", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("passed", F.sum("size").over(mine))
    return d.withColumn("taken", (F.col("size") > 0) & (F.col("earlier") + F.col("passed") <= total))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies: a row for each document."""
    q = queue(sized(docs))
    out = q.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.count_if("taken").cast("long").alias("copies"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with exactly the input's columns."""
    names = docs.columns
    row, n = own_name("row", names), own_name("n", names)
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    times = queue(sized(numbered, row)).where("taken").groupBy(F.col("row").alias(row)).agg(F.count("*").cast("int").alias(n))
    return numbered.join(times, row).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in names])


#: The query in DuckDB; like the operator it divides as doubles.
_MIX = r"""
z AS (SELECT {keys}, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5(coalesce(text, '')), 1, 16) AS digest FROM {source}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS p FROM z GROUP BY source),
s1 AS (SELECT *, CASE p % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
  sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM s1),
s3 AS (SELECT *, max(share) FILTER (WHERE rest * weight <= cap * share) OVER () AS l_share, min(rest) FILTER (WHERE rest * weight <= cap * share) OVER () AS x FROM s2),
s4 AS (SELECT s3.source, s3.source_size, least(CAST(s3.cap AS DOUBLE), CAST(s3.weight * l.rest AS DOUBLE) / CAST(l.share AS DOUBLE)) AS target FROM s3 JOIN s2 l ON l.share = s3.l_share),
q AS (SELECT z.*, s4.source_size, s4.target, r.round, md5(r.round || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest) AS draw
  FROM z JOIN s4 ON coalesce(z.source, chr(1)) = coalesce(s4.source, chr(1)) JOIN (SELECT 0 AS round UNION ALL SELECT 1 UNION ALL SELECT 2) r ON r.round = 0 OR r.round * s4.source_size < s4.target),
f AS (SELECT *, CASE WHEN target = 0 THEN 0 ELSE CAST(sum(size) OVER (PARTITION BY source ORDER BY round, draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target END AS finish FROM q),
n AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS passed FROM f),
u AS (SELECT sum(size) AS budget FROM z)
"""
_TAKEN = """SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN passed <= budget THEN size ELSE 0 END) AS BIGINT) AS taken, count(*) FILTER (WHERE size > 0 AND passed <= budget) AS copies
FROM n, u GROUP BY doc_id, size, source_size, target"""
ORACLE_SQL = "WITH " + _MIX.replace("{keys}", "doc_id").replace("{source}", "documents") + _TAKEN
