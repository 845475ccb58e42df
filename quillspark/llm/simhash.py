"""Operator 7, SimHash near-dedup with a pigeonring filter.

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Documents link where fingerprints differ
in at most two bits; a component's id is its smallest document id.

Equal fingerprints are one class from the start. Candidates come from chains on a ring of eight segments: two classes that link have, from
some segment on, a chain whose differences stay within the proportional budget at each length (none over three segments, one over four to
seven, two over all eight). Classes meet in lists of a start and its first three segments; in a list each pair's chain is followed
segment by segment, and a pair that stays within every budget up to all eight segments, the full Hamming check, is linked.

A dense group of near copies makes long lists, whose pairs would be too many. A class in a list of over LIST that shares a chain of four segments with
another is checked without pairs: classes link exactly if a value within one bit of both exists, so each emits those 65 values, and at most 65 classes
meet at a value. Both ways are exact, so the length of a list changes the cost only. Components are then found by alternating stars over
the links. There are no pairs of a group, however many copies it has, and no cap. Null and empty texts have the fingerprint zero and link like
any other. Repeated rows are copies. A null doc_id is never a component's id unless it is alone. An empty table gives an empty one.

The pipeline's stage (deduplicated) links texts by the Jaccard similarity of their sets of five-word shingles, 0.8 at least; words and
similarity are its parameters. It begins with the same steps: fingerprints of the sets, classes, chains and the full Hamming check give candidates, whose sets
are then compared exactly. A 64-bit fingerprint doesn't reach every such pair: at 0.8 they differ in ten bits or so, some in eighteen, as do
one in some 2,700 pairs of unrelated fingerprints, too many for any budget of the ring. So what the chains have not connected is found exactly, by prefixes: with any fixed order of shingles, two sets of
similarity s share one of the first n - ceil(s n) + 1. The order puts shingles that are frequent in a sample last, which changes only the cost.
Equal sets are one class. Candidates that their sizes, or bit marks of their sets, show to be less similar are passed over, by bounds that no similar
pair exceeds: first few marks, which the lists carry, then those in proportion to the set, which leave hardly any pair under the similarity. All others are
checked exactly, so within the hash's 64 bits no pair is missed and none is linked wrongly; only their texts are hashed again, and only their sets move. After the chains each text is
compared with one centre; then, in long lists of a shingle, centres are compared with the rest in rounds, four times as many in each; members already in
the centre's component are passed over. So a large group of near copies costs its size and not its pairs, and no list is capped: rounds go on until all
pairs are compared or connected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bucketed, discard, own_name, rows, staged, two

WORDS, SEED, SEGMENTS, FAR, LIST = 3, 42, 8, 2, 32
NEAR_WORDS, SIMILARITY = 5, 0.8
#: Rows whose shingles are counted for the order, and the most frequent shingles that it puts last; lists of a shingle that are short.
SAMPLE, FREQUENT, SHORT, MARKS = 10_000, 200_000, 8, 8
#: Links in a file while components are contracted.
EDGES = 500_000


def hashes(text: str, k: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of k words, repeats included."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z, and only space and U+0009-U+000D
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(sizes)
    n = len(words) - k + 1
    starts, stops = (ends - sizes)[:n].tolist(), (ends[k - 1 :] - 1).tolist()
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches):
        for ids, texts in rows(batches):
            fps = np.array([fingerprint(hashes(t)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return two(docs).mapInArrow(run, "doc_id long, fp long")


def _turned(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _within(x: Column) -> Column:
    """Whether differences x, turned to the chain's start, stay within the budget of each length."""
    ok = F.bit_count(x) <= FAR
    for length in range(SEGMENTS - 1, 2, -1):
        ok = ok & (F.bit_count(F.shiftrightunsigned(x, 64 - length * 64 // SEGMENTS)) <= length * FAR // SEGMENTS)
    return ok


def linked(fps: DataFrame, short: int = LIST) -> DataFrame:
    """(a, b), b < a: links of distinct fp that connect all that differ in FAR bits or fewer."""
    step = 64 // SEGMENTS
    chains = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("i"), _turned(F.col("fp"), i * step).alias("r")) for i in range(SEGMENTS)])).alias("c"))
    chains = chains.select("fp", "c.i", "c.r", F.shiftrightunsigned("c.r", 40).cast("int").alias("three"))
    sizes = staged(chains.groupBy("i", "three").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    lists = chains.join(sizes.where(F.col("n") <= short), ["i", "three"]).groupBy("i", "three").agg(F.array_sort(F.collect_list(F.struct("fp", "r"))).alias("have"))  # at most short
    pair = F.flatten(F.transform("have", lambda x, k: F.transform(F.slice("have", k + 2, F.size("have")), lambda y: F.struct(x["fp"].alias("b"), y["fp"].alias("a"), x["r"].bitwiseXOR(y["r"]).alias("x")))))
    pairs = lists.select(F.explode(F.filter(pair, lambda p: _within(p["x"]))).alias("p")).select("p.a", "p.b")
    dense = survivors(chains.join(sizes.where(F.col("n") > short), ["i", "three"], "left_semi"))
    return pairs.unionByName(links(dense)).distinct()


def survivors(chains: DataFrame) -> DataFrame:
    """fp of the classes that share a chain of four segments, within its budgets, with another class of their list."""
    chains = chains.withColumn("fourth", F.shiftrightunsigned("r", 32).bitwiseAND(F.lit(255)).cast("short"))
    heads = chains.groupBy("i", "three", "fourth").agg(F.count("*").alias("n"))
    lists = heads.groupBy("i", "three").agg(F.sum("n").alias("all"), F.collect_list(F.struct("fourth", "n")).alias("have")).where(F.col("all") > 1)  # at most 256 entries
    near = lambda x: (x["n"] > 1) | F.exists("have", lambda y: (y["fourth"] != x["fourth"]) & (F.bit_count(y["fourth"].bitwiseXOR(x["fourth"])) <= 1))
    live = lists.select("i", "three", F.explode(F.transform(F.filter("have", near), lambda x: x["fourth"])).alias("fourth"))
    return chains.join(live, ["i", "three", "fourth"], "left_semi").select("fp").distinct()


def links(some: DataFrame) -> DataFrame:
    """(a, b), b < a: a star of each value that lies within one bit of two classes or more."""
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)])
    met = some.select("fp", F.explode(near).alias("value")).groupBy("value").agg(F.collect_list("fp").alias("have")).where(F.size("have") > 1)  # at most 65
    return met.select(F.array_min("have").alias("b"), F.explode("have").alias("a")).where("a != b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node with an edge, root < a or a = root: alternating large and small stars until nothing changes."""

    def smallest(sym: DataFrame) -> DataFrame:
        low = sym.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        return sym.join(low.hint("shuffle_merge"), "a")

    before, edges = None, staged(edges, "links")
    files = 1 + edges.count() // EDGES  # links shrink in number: they never need more
    while True:
        last = edges
        if files == 1:  # EDGES links at most: a single task needs no shuffle
            edges = edges.coalesce(1)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if files == 1:
            both = both.coalesce(1)
        large = smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = smallest(large)
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        edges = staged(small.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a != b").distinct(), "stars", files)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).collect()[0]  # three numbers
        discard(last)
        if now == before:
            return edges.select("a", F.col("b").alias("root"))
        before = now


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    every = staged(fingerprints(docs), "fingerprints")
    classes = staged(every.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    stars = components(linked(classes.select("fp")))
    rooted = classes.join(stars, classes.fp == stars.a, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest.hint("shuffle_merge"), "root").select("fp", "component_id")
    return every.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with four or more texts of a sample, and their counts, in the shingles' order."""
    total = texts.count()
    share = min(1.0, SAMPLE / max(1, total))

    def run(batches):
        for ids, some in rows(batches):
            u, n = np.unique(np.concatenate([np.unique(hashes(t, words)) for t in some]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "n"])

    drawn = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    top = drawn.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def _sets(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """id, key (a digest of the set), n, fp (the set's fingerprint), marks (for each of 64 * MARKS bits, whether an odd number of shingles has it), bits (_bits) and prefix of every text."""
    import xxhash

    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, words))  # at most FREQUENT

    def run(batches):
        often, counts = shared.value
        for ids, some in rows(batches):
            keys, sizes, fps, marks, bits, prefixes = [], [], [], [], [], []
            for t in some:
                h = np.unique(hashes(t, words))
                keys.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
                sizes.append(len(h))
                fps.append(fingerprint(h))
                odd = np.bincount((h % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1
                marks.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                bits.append(_bits(h))
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    h = h[np.argsort(np.where(often[at] == h, counts[at], 0), kind="stable")]
                prefixes.append(h[: len(h) - math.ceil(similarity * len(h) - 1e-6) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), *[pa.array(c, pa.list_(pa.int64())) for c in (marks, bits, prefixes)]], ["id", "key", "n", "fp", "marks", "bits", "prefix"])

    return texts.mapInArrow(run, "id long, key string, n long, fp long, marks array<long>, bits array<long>, prefix array<long>")


def _bits(h: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set has each bit; four bits a shingle at least, and a power of two of words, so that longer ones fold onto shorter ones."""
    words = 1 << max(0, -(-4 * len(h) // 64) - 1).bit_length()
    out, at = np.zeros(words, np.uint64), h & np.uint64(64 * words - 1)
    np.bitwise_xor.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def _close(pairs: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) without those whose bits differ in more places than the sets of a similar pair differ in shingles."""
    xor = lambda u, v: u.bitwiseXOR(v)
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), F.floor(F.size(x) / 2).cast("int")), F.slice(x, F.floor(F.size(x) / 2).cast("int") + 1, F.floor(F.size(x) / 2).cast("int")), xor)
    both = pairs.join(bits.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x")), "a").join(bits.select(F.col("id").alias("b"), "n", F.col("bits").alias("y")), "b")
    both = both.withColumn("p", F.when(F.size("x") > F.size("y"), half("x")).otherwise(F.col("x"))).withColumn("q", F.when(F.size("y") > F.size("x"), half("y")).otherwise(F.col("y")))
    differ = F.aggregate(F.zip_with("p", "q", lambda u, v: F.bit_count(xor(u, v))), F.lit(0), lambda t, v: t + v)
    return both.where(F.coalesce(differ, F.lit(0)) * (1 + similarity) <= (1 - similarity) * (F.col("n") + F.col("m")) + 1e-6).select("a", "b")


def _may(similarity: float) -> Column:
    """Whether sets of n and m shingles can be similar: by their sizes, and as they differ in one shingle at least for each bit of marks."""
    differ = sum((F.bit_count(F.get("x", F.lit(k)).bitwiseXOR(F.get("y", F.lit(k)))) for k in range(1, MARKS)), F.bit_count(F.get("x", F.lit(0)).bitwiseXOR(F.get("y", F.lit(0)))))
    return (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-6) & (differ * (1 + similarity) <= (1 - similarity) * (F.col("n") + F.col("m")) + 1e-6)


def _alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of the pairs (a, b) those whose sets are similar; and the table of sets, which may go when they are stored."""

    def run(batches):
        for ids, some in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([np.unique(hashes(t, words)).view(np.int64) for t in some], pa.list_(pa.int64()))], ["id", "s"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = bucketed(texts.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "id long, s array<long>"), "id", "sets", deal=False)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * (1 + similarity) >= similarity * (F.size("x") + F.size("y")) - 1e-6).select("a", "b"), sets


def ringed(classes: DataFrame) -> DataFrame:
    """(a, b): candidates among classes (id, fp). Each class meets the least id of its fingerprint, and these meet where fingerprints are linked."""
    least = staged(classes.groupBy("fp").agg(F.min("id").alias("least")), "least")
    same = classes.join(least, "fp").where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    near = linked(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.unionByName(near.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))


def near_copies(texts: DataFrame, words: int = NEAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id of texts (doc_id, text) with distinct ids: components of all pairs with the similarity or more.

    Texts in buckets of doc_id aren't shuffled for the checks of candidates.
    """
    found = staged(_sets(texts, words, similarity), "sets")
    full = staged(found.groupBy("key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "fp", "marks", "bits", "prefix")]), "classes")
    every, classes = staged(found.select("id", "key"), "keys"), staged(full.select("id", "key"), "names")
    discard(found)
    bits = bucketed(full.select("id", "n", "bits"), "id", "bits")

    def checked(pairs: DataFrame, edges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The edges, with those of the pairs that are similar, and their components."""
        close = staged(_close(pairs, bits, similarity), "close")
        found, sets = _alike(close, texts, words, similarity)
        edges = staged((found if edges is None else edges.unionByName(found)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        stars = components(edges)
        discard(sets, close)
        return edges, stars.withColumnRenamed("a", "id")

    tested = staged(ringed(full.select("id", "fp")), "pairs")
    edges, stars = checked(tested, None)
    rooted = lambda d: d.join(stars, "id", "left").withColumn("root", F.coalesce("root", "id"))
    w = Window.partitionBy("token")
    lists = full.select(F.explode("prefix").alias("token"), "id").withColumn("size", F.count("*").over(w)).where("size > 1").withColumn("k", F.row_number().over(w.orderBy("id")))
    lists = staged(rooted(lists.join(full.select("id", "n", F.col("marks").alias("x")), "id")), "lists")
    discard(full)
    left, done, wide, spent = lists, 0, 0, [bits, lists, tested]
    while not left.isEmpty():
        # at first each list's least member is its centre, and a text is compared with the least of its lists' centres only
        centre = (F.col("k") == 1) if not wide else (F.col("k") > done) & ((F.col("k") <= done + wide) | (F.col("size") <= SHORT))
        centres = left.where(centre).select("token", F.col("id").alias("a"), F.col("n").alias("m"), F.col("x").alias("y"), F.col("k").alias("c"), F.col("root").alias("r"))
        met = left.join(centres, "token").where((F.col("k") > F.col("c")) & (F.col("root") != F.col("r")) & _may(similarity))
        pairs = met.groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).select("a", "b") if not wide else met.select("a", F.col("id").alias("b")).distinct()
        pairs = staged(pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
        edges, stars = checked(pairs, edges)
        tested = tested.unionByName(pairs)
        spent.append(pairs)
        if left is not lists:
            discard(left)
        done, wide = done + wide, 4 * wide or 1
        # lists with members of two components or more, and centres left
        left = rooted(lists.drop("root").where((F.col("size") > SHORT) & (F.col("size") > done + 1) if done else F.lit(True)))
        left = staged(left.withColumn("low", F.min("root").over(w)).withColumn("high", F.max("root").over(w)).where("low < high").drop("low", "high"), "left")
    discard(*spent, *([left] if left is not lists else []))
    named = rooted(classes).select("key", F.col("root").alias("component_id"))
    return every.select("id", "key").withColumnRenamed("id", "doc_id").join(named, "key").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, exactly one of each component: by least doc_id, nulls last, then by place. Ids may be null, repeat or clash."""
    names = docs.columns
    row = own_name("row", names)
    numbered = bucketed(docs.withColumn(row, F.monotonically_increasing_id()), row, "numbered")  # the text is shuffled here and no more
    groups = near_copies(numbered.select(F.col(row).alias("doc_id"), "text"), words, similarity).select(F.col("doc_id").alias(row), "component_id")
    keyed = numbered.select(row, F.col("doc_id").cast("long").alias("id")).join(groups, row)
    first = keyed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(row).alias("row"))).alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(first.hint("shuffle_merge"), row, "left_semi").select(*[F.col(f"`{c}`") for c in names])
