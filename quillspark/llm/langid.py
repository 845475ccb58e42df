"""Operator 9, language identification with spans.

Words are runs of letters. A word's script range narrows the languages that it can be in; a model of hashed character bigrams and
trigrams scores the rest; Viterbi over the words' scores, with a penalty for each switch, labels spans. A document's language is that of
most of its labelled letters, and its score their share.

The model counts n-grams of a bounded sample: documents with a language, in the learning part, drawn by a hash so that about
SAMPLE of each language are expected; counting is distributed and what reaches the driver is a table of languages by bins, whose
size is that of the languages times BINS. Only text and lang are learned from. Null text and text without letters (numerals such as fractions
are none) give 'und' and score 0. Words whose script no language has are neutral. Ties go to the language first by code points. An empty
table, or one without labels, gives 'und' for all. A null doc_id isn't held out; repeated rows are labelled alike. Texts are labelled in
slices, words are scored in blocks and long texts cut into words by stretches, so a worker's memory doesn't grow with a text's distinct words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import rows, two

SAMPLE, BINS, PENALTY, OTHER = 1500, 1 << 16, 20.0, "und"
#: Letters of distinct words that are scored at once, characters of text that are cut into words at once, words that are traced at once.
LETTERS, PIECE, STEP = 1 << 18, 1 << 20, 1 << 18
SLICE = 2 << 20  # bytes of text that are labelled together


def _class(chars: list[int]) -> str:
    """Code points in order as ranges of a pattern's class."""
    out: list[list[int]] = []
    for c in chars:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in out)


#: Runs of letters: of word characters without digits, other numerals (fractions, Roman ones, powers) and the underscore.
WORD_CHARS = re.compile(r"[^\W\d_]+")  # the same with numerals: quick, and right wherever all that it finds is letters
WORD = re.compile(rf"[^\W\d_{_class([c for c in range(0x110000) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()])}]+")
#: Where script ranges start, and each range's script (fixed values).
STARTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0x980, 0xE00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFF00, 0x20000])
SCRIPTS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0, 1, 0, 12, 13, 13, 10, 0, 13, 0, 0, 13])
N_SCRIPTS = 14


def held_out(key="doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of bigrams and trigrams of the words, one beside the other for each letter; where each word starts; its script."""
    flat = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    inner = np.flatnonzero(flat != 32)
    tri = flat[inner - 1] * np.uint64(0x9E3779B1) ^ flat[inner] * np.uint64(0x85EBCA77) ^ flat[inner + 1] * np.uint64(0xC2B2AE3D)
    bi = flat[inner - 1] * np.uint64(0x27D4EB2F) + flat[inner] * np.uint64(0x165667B1) + np.uint64(7)
    mix = lambda x: (((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(BINS)).astype(np.int64)
    lens = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(lens) - lens
    script = SCRIPTS[np.searchsorted(STARTS, flat[inner][starts], "right") - 1]
    return np.stack([mix(bi), mix(tri)], 1), starts, script


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # bins by languages: log of probabilities
    scripts: np.ndarray  # scripts by languages: may a word of this script be in this language

    def score(self, words: list[str]) -> np.ndarray:
        """Words by languages; a language that a word's script excludes has a low score, unless the script excludes all."""
        out, k = np.zeros((len(words), len(self.langs)), np.float32), 0
        while k < len(words):  # a block of words at a time: what a gram takes is many times its letter
            start, size = k, 0
            while k < len(words) and (k == start or size + len(words[k]) <= LETTERS):
                size += len(words[k])
                k += 1
            out[start:k] = self._block(words[start:k])
        return out

    def _block(self, words: list[str]) -> np.ndarray:
        grams, starts, script = _grams(words)
        s = np.add.reduceat(self.weights[grams].sum(1), starts, axis=0)
        s -= s.max(1, keepdims=True)
        may = self.scripts[script]
        s = np.where(may, s, s.min(1, keepdims=True) - 5)
        s[~may.any(1)] = 0
        return s - s.max(1, keepdims=True)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from the rows' text and lang, a bounded sample of them."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    langs = sorted(sizes)
    part = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))]), F.col("lang"))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(97)), F.lit(1 << 20)) < part * (1 << 20))
    at = {k: i for i, k in enumerate(langs)}
    size = BINS + N_SCRIPTS

    def tally(batches):
        total = np.zeros((len(langs), size), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for words in words_of(text):
                    if words:
                        grams, _, script = _grams([w.lower() for w in words])
                        np.add.at(total[at[lang]], grams.ravel(), 1)
                        np.add.at(total[at[lang]], BINS + script, 1)
        lang, b = np.nonzero(total)
        if len(b):
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(b, pa.int32()), pa.array(total[lang, b], pa.int64())], ["lang", "bin", "n"])

    table = drawn.select("lang", "text").mapInArrow(tally, "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    total = np.zeros((len(langs), size))
    for r in table.toLocalIterator():  # at most languages x bins
        total[r["lang"], r["bin"]] = r["n"]
    grams, scripts = total[:, :BINS] + 0.05, total[:, BINS:]
    weights = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
    return Model(langs, np.ascontiguousarray(weights), (scripts > 0.001 * scripts.sum(1, keepdims=True)).T)


def viterbi(scores: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """The best label of each word in each document; documents go in step, the longest first."""
    order = sorted(range(len(scores)), key=lambda d: -len(scores[d]))
    lens = np.array([len(scores[d]) for d in order])
    if not len(lens) or not lens[0]:
        return [np.zeros(len(s), np.int64) for s in scores]
    starts = np.cumsum(lens) - lens
    flat = np.concatenate([scores[d] for d in order])
    best = flat[starts[lens > 0]].astype(np.float64)
    stay, top = np.ones(flat.shape, bool), np.zeros(len(flat), np.int32)
    for t in range(1, lens[0]):
        k = int(np.searchsorted(-lens, -t, "left"))  # documents with more than t words
        v = best[:k]
        high = v.argmax(1)
        jump = v[np.arange(k), high] - penalty
        at = starts[:k] + t
        stay[at] = v >= jump[:, None]
        top[at] = high
        best[:k] = np.maximum(v, jump[:, None]) + flat[at]
    out = [np.zeros(0, np.int64)] * len(scores)
    for j, d in enumerate(order):
        labels = np.zeros(lens[j], np.int64)
        if lens[j]:
            now = int(best[j].argmax())
            for t in range(lens[j] - 1, -1, -1):
                labels[t] = now
                if t and not stay[starts[j] + t, now]:
                    now = int(top[starts[j] + t])
        out[d] = labels
    return out


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, in lists of a bounded stretch each."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # on to the end of the word
            end = m.end() if (m := WORD_CHARS.match(text, end)) else end
        found = WORD_CHARS.findall(text, at, end)
        yield found if all(map(str.isalpha, found)) else WORD.findall(text, at, end)
        at = end


def _one_label(codes: np.ndarray, table: np.ndarray) -> int | None:
    """The label of all words, if no other language gains half the penalty over any stretch: then no switch pays."""
    total = np.zeros(table.shape[1])
    for k in range(0, len(codes), STEP):
        total += table[codes[k : k + STEP]].sum(0, dtype=np.float64)
    b = int(total.argmax())
    before, low = np.zeros(table.shape[1]), np.zeros(table.shape[1])
    for k in range(0, len(codes), STEP):
        s = table[codes[k : k + STEP]]
        gain = np.concatenate([before[None], before + np.cumsum(s - s[:, b : b + 1], axis=0, dtype=np.float64)])
        least = np.minimum(np.minimum.accumulate(gain, axis=0), low)
        if (gain[1:] - least[:-1]).max() > PENALTY / 2:
            return None
        before, low = gain[-1], least[-1]
    return b


def labelled(model: Model, texts: list[str]) -> list[tuple[str, float, list[np.ndarray]]]:
    """Language, score and each word's label of every text.

    Documents with one label throughout are told without tracing (_one_label); the others are traced, about STEP words at once.
    """
    code: defaultdict[str, int] = defaultdict(count().__next__)
    get = code.__getitem__
    words = [np.concatenate([np.zeros(0, np.int32), *(np.fromiter(map(get, some), np.int32, len(some)) for some in words_of(t))]) for t in texts]
    table = model.score([w.lower() for w in code])
    size = np.fromiter(map(len, code), np.int64, len(code))
    labels: list = [None] * len(texts)
    open_: list[int] = []
    for d, w in enumerate(words):
        b = _one_label(w, table) if len(w) else 0
        if b is None:
            open_.append(d)
        else:
            labels[d] = np.full(len(w), b, np.int32)
    while open_:
        some, n = [open_.pop()], 0
        while open_ and (n := n + len(words[open_[-1]])) < STEP:
            some.append(open_.pop())
        for d, found in zip(some, viterbi([table[words[d]] for d in some])):
            labels[d] = found.astype(np.int32)
    out = []
    for d, w in enumerate(words):
        if not len(w):
            out.append((OTHER, 0.0, labels[d]))
            continue
        share = np.bincount(labels[d], size[w], len(model.langs))
        b = int(share.argmax())
        out.append((model.langs[b], float(share[b] / share.sum()), labels[d]))
    return out


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(start, end, language) of the stretches of one text, in code points."""
    found = [m.span() for m in WORD.finditer(text)]
    (_, _, labels) = labelled(model, [text])[0]
    out: list = []
    for (a, z), k in zip(found, labels.tolist()):
        if out and out[-1][2] == model.langs[k]:
            out[-1] = (out[-1][0], z, out[-1][2])
        else:
            out.append((a, z, model.langs[k]))
    return out


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every row; without a model, one is learned from the rows that aren't held out."""
    model = model or learn(docs.where(~F.coalesce(held_out(), F.lit(False))).select("doc_id", "text", "lang"))
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # bins x languages: a fixed size

    def run(batches):
        m = shared.value
        for ids, texts in rows(batches, SLICE):
            got = labelled(m, texts) if m else [(OTHER, 0.0, None)] * len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return two(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return identified(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def kept(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows with a language that holds at least half of the letters, with exactly the input's columns."""
    model = learn(docs.where(~F.coalesce(held_out(), F.lit(False))).select("doc_id", "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            at, two_of = 0, batch.select(["doc_id", "text"])
            for _, some in rows(iter([two_of]), SLICE):
                got = labelled(m, some) if m else [(OTHER, 0.0, None)] * len(some)
                yield batch.slice(at, len(some)).filter(pa.array([lang != OTHER and s >= least for lang, s, _ in got], pa.bool_()))
                at += len(some)

    return docs.mapInArrow(run, docs.schema)
