"""Operator 3, byte-level BPE encoding and decoding over a distinct-word table.

A *word* here is a stretch that the tokenizer's own splitting never joins with its neighbours: a run of non-blanks with at most
one space before it, or a run of blanks; the library itself is asked which characters are white space. Words are split in Spark (one pass, one local dictionary for a chunk of documents); the
chunks' distinct words are dealt out by a hash, so that each distinct word of the corpus meets in one place and is encoded once;
its ids go back to every chunk by position in the chunk's dictionary. Decoding looks each id up in the id-to-piece table, whose size
is the vocabulary's.

What is shuffled is one entry per chunk and distinct word, never one per occurrence: a word that makes up a third of the corpus
weighs as much as any other. Long texts are cut into words by stretches. Rows with equal or null ids stay separate rows. Null text is empty: no ids. Special tokens that occur in a text get their ids, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bucketed, rows, two

#: Characters that some library or Unicode version classes as white space; of each, the vocabulary's own library is asked (fixed values).
MAYBE_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x2010))) + "".join(map(chr, range(0x2028, 0x2030))) + "".join(map(chr, range(0x205F, 0x2065))) + "\u3000\ufeff"
#: Characters that every Unicode version classes alike; other words go through the tokenizers library itself.
SURE = re.compile(r"[\t-\r -~\xa0-\u0220\u0250-\u02ad\u0400-\u0481\u1e00-\u1e9b\u2010-\u2027\u2030-\u205e\u20ac]*").fullmatch
CHUNK = 24 << 20  # bytes of text in a chunk
CODES = 400_000
PIECE = 1 << 20  # characters of a text that are cut into words at once
MOST, MOST_CHARS = 300_000, 6 << 20  # words, and characters of words, that a worker's table holds


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(4)
def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """One vocabulary in one worker: exact ids of words, and the pieces of ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, self.special = byte_alphabet(), {x["content"]: x["id"] for x in spec["added_tokens"]}
        raw = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=raw, special_tokens={})
        pieces = [b""] * (1 + max([*raw.values(), *self.special.values()]))
        for p, i in [*raw.items(), *((s.encode(), i) for s, i in self.special.items())]:
            pieces[i] = p
        self.pieces = pa.array(pieces, pa.binary())
        self.decimals = pa.array([f"{i},".encode() for i in range(len(pieces))], pa.binary())
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        ws = re.escape("".join(c for c in MAYBE_WHITE if self._white(c)))
        self.visible = re.compile(f"[^{ws}]").search
        self.split = re.compile(f" ?[^{ws}]+|[{ws}]+(?![^{ws}])|[{ws}]+").findall
        self.seam = re.compile(f"[^{ws}](?=[{ws}])").search

    def _white(self, c: str) -> bool:
        """Whether the library's own splitting takes c for white space: of a run of it the last is parted, and only a space goes with what follows."""
        return any(start == 2 for _, (start, _) in self.library.pre_tokenizer.pre_tokenize_str(f"a {c}b"))

    def words(self, text: str) -> list[str]:
        """Stretches of text, in order and without loss, whose encodings make up the text's."""
        return [w for some in self.cut(text) for w in some]

    def cut(self, text: str) -> Iterator[list[str]]:
        """The same in lists of a bounded stretch of text each (or one word, if it is longer)."""
        for part in self.specials.split(text) if self._has_special(text) else (text,):
            if part in self.special:
                yield [part]
            else:
                for at, end in self._stretches(part):
                    yield self.split(part, at, end)

    def _has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _stretches(self, text: str) -> Iterator[tuple[int, int]]:
        """Bounds of stretches that end where white space begins."""
        at = 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                end = m.end() if (m := self.seam(text, end)) else len(text)
            yield at, min(end, len(text))
            at = end

    def whole(self, text: str) -> list[int] | None:
        """The ids of a text that the rank-based encoder reads as the library does; None for other texts, which go by words."""
        if not SURE(text) or self._has_special(text):
            return None
        if len(text) <= PIECE:
            return self.fast.encode_ordinary(text)
        return [i for at, end in self._stretches(text) for i in self.fast.encode_ordinary(text[at:end])]

    def ids(self, word: str) -> list[int]:
        if SURE(word) and word not in self.special:
            return self.fast.encode_ordinary(word)
        return self.library.encode(word, add_special_tokens=False).ids

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 of each document's decoded text; ends: where each document's ids end."""
        out, start = [], 0
        whole = self.pieces.take(pa.array(ids, pa.int64()))
        at = np.frombuffer(whole.buffers()[1], np.int32)
        data = memoryview(whole.buffers()[2]) if len(ids) else b""
        for end in ends.tolist():
            b = bytes(data[at[start] : at[end]]) if end > start else b""
            try:
                b.decode()
            except UnicodeDecodeError:
                b = b.decode(errors="replace").encode()
            out.append(b)
            start = end
        return out


@lru_cache(4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def ragged(lens: np.ndarray, starts: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a sequence of word codes, and how many each word has."""
    n = lens[codes]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts[codes] - (ends - n), n) + np.arange(total, dtype=np.int64)
    return flat[at], n


class WordIds:
    """Ids of many texts by way of a per-worker word table, which is emptied when it holds too many words or characters."""

    def __init__(self, path: str, most: int = MOST, chars: int = MOST_CHARS):
        self.bpe, self.most, self.most_chars = bpe(path), most, chars
        self.clear()

    def clear(self) -> None:
        self.code: defaultdict[str, int] = defaultdict(count().__next__)
        self.known = self.used = self.chars = 0
        self.lens, self.starts, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)

    def _learn(self) -> None:
        """Encode the words that came in since the last time."""
        new = list(islice(self.code, self.known, None))
        ids = [self.bpe.ids(w) for w in new]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        ends, total = self.used + np.cumsum(n), self.used + int(n.sum())
        if len(self.code) > len(self.lens):
            self.lens, self.starts = (np.concatenate([x, np.zeros(len(self.code), np.int64)]) for x in (self.lens, self.starts))
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(total, np.int32)])
        self.lens[self.known : len(self.code)], self.starts[self.known : len(self.code)] = n, ends - n
        self.flat[self.used : total] = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        self.known, self.used, self.chars = len(self.code), total, self.chars + sum(map(len, new))

    def encode(self, texts: list[str], keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """Ids of all texts, how many ids each word has, how many words each text has, and with keep each text's words."""
        if self.known > self.most or self.chars > self.most_chars:
            self.clear()
        codes, sizes, words, get = [np.zeros(0, np.int32)], [], [], self.code.__getitem__
        for t in texts:
            n, mine = 0, []
            for some in self.bpe.cut(t):
                codes.append(np.fromiter(map(get, some), np.int32, len(some)))
                n += len(some)
                if keep:
                    mine += some
            sizes.append(n)
            words.append(mine)
        if len(self.code) > self.known:
            self._learn()
        ids, n = ragged(self.lens, self.starts, self.flat, np.concatenate(codes))
        return ids, n, np.array(sizes, np.int64), words


def _split(path: str, buckets: int, size: int):
    """Documents to one row a chunk: its documents, the word codes of all its texts, and its distinct words by bucket.

    A word's code is its place in the chunk's dictionary, which is ordered by bucket: bucket b has codes firsts[b] to firsts[b+1].
    """
    import xxhash

    def run(batches):
        from pyspark import TaskContext

        part, seq, own, press = TaskContext.get().partitionId(), 0, bpe(path), zstandard.ZstdCompressor(3).compress
        ids, counts, code, codes, held = [], [], defaultdict(count().__next__), [], 0

        def chunk():
            words = list(code)
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int32, len(words))
            order = sorted(range(len(words)), key=words.__getitem__)
            order = np.array(order, np.int64)[np.argsort(bucket[order], kind="stable")]
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            firsts = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32)
            lists = []
            for b in range(buckets):
                mine = [words[k].encode() for k in order[firsts[b] : firsts[b + 1]].tolist()]
                lists.append(press(np.array([len(w) for w in mine], np.uint32).tobytes() + b"".join(mine)) if mine else b"")
            flat = place[np.concatenate(codes)] if codes else np.zeros(0, np.int32)
            planes = b"".join(((flat >> s) & 255).astype(np.uint8).tobytes() for s in (0, 8, 16, 24))
            return {"chunk": (part << 32) + seq, "doc_ids": ids, "counts": counts, "codes": press(planes), "firsts": firsts.tolist(), "words": lists}

        for some, texts in rows(batches):
            get = code.__getitem__
            for t in texts:
                n = 0
                for words in own.cut(t):
                    codes.append(np.fromiter(map(get, words), np.int32, len(words)))
                    n += len(words)
                counts.append(n)
            ids += some
            held += sum(map(len, texts))
            if held >= size:
                yield pa.RecordBatch.from_pylist([chunk()], schema=CHUNKS)
                seq, ids, counts, code, codes, held = seq + 1, [], [], defaultdict(count().__next__), [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([chunk()], schema=CHUNKS)

    return run


CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary()), ("firsts", pa.list_(pa.int32())), ("words", pa.list_(pa.binary()))])


def _unpack(blob: bytes, n: int) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n)).tolist()
    body, out, start = raw[4 * n :], [], 0
    for end in ends:
        out.append(body[start:end].decode())
        start = end
    return out


def _encode_bucket(path: str):
    """Word lists of one or more buckets to their ids; within a task each distinct word is encoded once."""

    def run(batches):
        own, press, known, now = bpe(path), zstandard.ZstdCompressor(3).compress, {}, None
        for batch in batches:
            for x in batch.to_pylist():
                if x["bucket"] != now:
                    known, now = {}, x["bucket"]
                got = []
                for w in _unpack(x["words"], x["n"]):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array(own.ids(w), np.int32).tobytes()
                    got.append(ids)
                lens = np.array([len(g) // 4 for g in got], np.int32).tobytes()
                yield pa.RecordBatch.from_pylist([{"chunk": x["chunk"], "first": x["first"], "n": x["n"], "ids": press(lens + b"".join(got))}], schema=BACK)

    return run


BACK = pa.schema([("chunk", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("ids", pa.binary())])


def _assemble(path: str, keep_ids: bool):
    """A chunk's documents, word codes and word ids to one row a document."""

    def run(batches):
        own, unpress = bpe(path), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for x in batch.to_pylist():
                lens, flats = [], []
                for b in sorted(x["back"] or [], key=lambda b: b["first"]):
                    raw = np.frombuffer(unpress(b["ids"]), np.int32)
                    lens.append(raw[: b["n"]])
                    flats.append(raw[b["n"] :])
                lens = np.concatenate(lens).astype(np.int64) if lens else np.zeros(0, np.int64)
                flat, starts = np.concatenate(flats) if flats else np.zeros(0, np.int32), np.cumsum(lens) - lens
                planes = np.frombuffer(unpress(x["codes"]), np.uint8).reshape(4, -1)
                counts, at, k = np.array(x["counts"], np.int64), 0, 0
                while k < len(counts):  # so many words at a time, a document at least
                    far = np.cumsum(counts[k:])
                    m = max(1, int(np.searchsorted(far, CODES, "right")))
                    n = int(far[m - 1])
                    codes = sum(planes[p, at : at + n].astype(np.int64) << (8 * p) for p in range(4))
                    ids, per = ragged(lens, starts, flat, codes)
                    ends = np.concatenate([[0], np.cumsum(per)])[far[:m]]
                    yield pa.RecordBatch.from_pylist([r for r in _digests(own, x["doc_ids"][k : k + m], ids, ends, keep_ids)], schema=_out(keep_ids))
                    at, k = at + n, k + m

    return run


def _digests(own: Bpe, doc_ids: list, ids: np.ndarray, ends: np.ndarray, keep_ids: bool):
    texts = own.decode_all(ids, ends)
    decimal = own.decimals.take(pa.array(ids, pa.int64()))
    at = np.frombuffer(decimal.buffers()[1], np.int32)
    data = memoryview(decimal.buffers()[2]) if len(ids) else b""
    start = 0
    for i, end, decoded in zip(doc_ids, ends.tolist(), texts):
        row = {"doc_id": i, "n_tokens": end - start, "ids_sha256": hashlib.sha256(data[at[start] : at[end] - 1] if end > start else b"").hexdigest(), "decoded_sha256": hashlib.sha256(decoded).hexdigest()}
        yield row | ({"ids": ids[start:end].tolist(), "decoded": decoded.decode()} if keep_ids else {})
        start = end


def _out(keep_ids: bool) -> pa.Schema:
    s = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return pa.schema([*s, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]) if keep_ids else s


def encode_decode(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, and with keep_ids the ids and the decoded text.

    Rows with equal ids are separate documents. The chunks are written once to the shared folder as a table bucketed by chunk,
    so that a lost executor repeats reads only and the word codes, its largest column, aren't shuffled.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "chunk long, doc_ids array<long>, counts array<long>, codes binary, firsts array<int>, words array<binary>"
    chunks = bucketed(two(docs).mapInArrow(_split(path, n, chunk), schema), "chunk", "chunks", deal=False)
    words = chunks.select("chunk", "firsts", F.posexplode("words").alias("bucket", "words")).select(
        "chunk", "bucket", "words", F.get("firsts", F.col("bucket")).alias("first"), (F.get("firsts", F.col("bucket") + 1) - F.get("firsts", F.col("bucket"))).alias("n")
    ).where("n > 0")
    dealt = words.repartition(n, "bucket").sortWithinPartitions("bucket", "chunk")
    back = dealt.mapInArrow(_encode_bucket(path), "chunk long, first int, n int, ids binary")
    lists = back.groupBy("chunk").agg(F.collect_list(F.struct("first", "n", "ids")).alias("back"))  # at most one entry a bucket
    both = chunks.select("chunk", "doc_ids", "counts", "codes").join(lists.hint("shuffle_merge"), "chunk", "left")
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return both.select("doc_ids", "counts", "codes", "back").mapInArrow(_assemble(path, keep_ids), out)
