"""Operator 6, token counts that follow edits.

A document's tree is its text, cut into pre-token words in blocks, with a binary tree of sums of characters and tokens over the
blocks. trees() encodes every text once and gives the trees as a table (doc_id, text, lens, tokens: the words' characters and tokens),
which is stored; edited() takes that table and edits, brings the trees up to date and gives them back as such a table again, so that
edits of days to come start from there and never encode a text anew. An edit finds its block by the sums, re-encodes only the words that it touches
and their neighbours (as far as the tokenizer's splitting can look: the nearest whole word with a visible character on either side),
and updates the sums from the changed blocks to the root.

Null text is empty and has no tokens; edits of it apply to the empty text. Edits are (start, end, replacement) in code points,
clamped to the text, applied one after the other to the text as it is then. A special token's string that an edit makes or
breaks is seen: such texts are encoded anew. Repeated rows, and rows with a null doc_id, have trees of their own; edits of a table reach every row
with their doc_id, none with a null one. An empty table gives an empty table, and columns of the input beside doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bpe import WordIds, default_vocabulary
from quillspark.llm.common import rows, staged, two

BLOCK = 64
TREE = "doc_id long, text string, lens array<int>, tokens array<int>"
COUNTS = ("n_words", "n_tokens_before", "n_edits", "n_chars", "n_tokens", "reencoded_chars")


class CountTree:
    """One document's words, their token counts, and the tree of sums over blocks of them."""

    def __init__(self, words: list[str], tokens: np.ndarray, encoder: WordIds):
        self.encoder, self.reencoded = encoder, 0
        self._build(words, tokens)

    def _build(self, words: list[str], tokens) -> None:
        tokens = [int(t) for t in tokens]
        self.words = [words[k : k + BLOCK] for k in range(0, len(words), BLOCK)] or [[]]
        self.tokens = [tokens[k : k + BLOCK] for k in range(0, len(tokens), BLOCK)] or [[]]
        self.size = 1 << (len(self.words) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)  # characters, tokens; the root is row 1
        for b, (w, t) in enumerate(zip(self.words, self.tokens)):
            self.sums[self.size + b] = sum(map(len, w)), sum(t)
        low = self.size
        while low > 1:
            self.sums[low // 2 : low] = self.sums[low : 2 * low : 2] + self.sums[low + 1 : 2 * low : 2]
            low //= 2

    @classmethod
    def load(cls, text: str, lens: np.ndarray, tokens: np.ndarray, encoder: WordIds) -> CountTree:
        """The tree of a stored row."""
        ends = np.cumsum(lens)
        return cls([text[a:z] for a, z in zip((ends - lens).tolist(), ends.tolist())], tokens, encoder)

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def each_word(self) -> Iterator[str]:
        return (w for block in self.words for w in block)

    def text(self) -> str:
        return "".join(self.each_word())

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, word and the word's start of the character at place at (the last word's for the text's end)."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        b = node - self.size
        for k, w in enumerate(self.words[b]):
            if at < start + len(w) or k == len(self.words[b]) - 1:
                return b, k, start
            start += len(w)
        return b, 0, start

    def _update(self, b: int) -> None:
        node = self.size + b
        self.sums[node] = sum(map(len, self.words[b])), sum(self.tokens[b])
        while node := node // 2:
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        visible = self.encoder.bpe.visible
        if not self.n_chars:
            return self._whole(replacement)
        b0, k0, s0 = self._find(max(start - 1, 0))
        b1, k1, s1 = self._find(end)
        while (b0, k0) != (0, 0):  # back to a whole visible word before the edit
            if s0 + len(self.words[b0][k0]) <= start and visible(self.words[b0][k0]) and s0 < start:
                break
            b0, k0 = (b0, k0 - 1) if k0 else (b0 - 1, len(self.words[b0 - 1]) - 1)
            while not self.words[b0] and b0:
                b0, k0 = b0 - 1, len(self.words[b0 - 1]) - 1
            s0 -= len(self.words[b0][k0])
        while not (s1 >= end and visible(self.words[b1][k1])):  # on to one behind it
            s1 += len(self.words[b1][k1])
            nb, nk = b1, k1 + 1
            while nb < len(self.words) and nk >= len(self.words[nb]):
                nb, nk = nb + 1, 0
            if nb >= len(self.words):
                break
            b1, k1 = nb, nk
        old = "".join(w for b in range(b0, b1 + 1) for w in self.words[b][k0 if b == b0 else 0 : k1 + 1 if b == b1 else None])
        new = old[: start - s0] + replacement + old[end - s0 :]
        special = self.encoder.bpe.special
        if any(c in x for s in special for c in (s, s[:2], s[-2:]) for x in (old, new)):
            whole = self.text()
            return self._whole(whole[:start] + replacement + whole[end:])
        _, tokens, _, (words,) = self.encoder.encode([new], keep=True)
        self.reencoded += len(new)
        head, tail = (self.words[b0][:k0], self.tokens[b0][:k0]), (self.words[b1][k1 + 1 :], self.tokens[b1][k1 + 1 :])
        self.words[b0], self.tokens[b0] = head[0] + words, head[1] + tokens.tolist()
        if b1 == b0:
            self.words[b0], self.tokens[b0] = self.words[b0] + tail[0], self.tokens[b0] + tail[1]
        else:
            self.words[b1], self.tokens[b1] = list(tail[0]), list(tail[1])
            for b in range(b0 + 1, b1):
                self.words[b], self.tokens[b] = [], []
        if len(self.words[b0]) > 4 * BLOCK or not self.words[b0]:
            self._build([w for block in self.words for w in block], [t for block in self.tokens for t in block])
        else:
            for b in range(b0, b1 + 1):
                self._update(b)

    def _whole(self, text: str) -> None:
        _, tokens, _, (words,) = self.encoder.encode([text], keep=True)
        self.reencoded += len(text)
        self._build(words, tokens)


#: The edits that the query follows: addresses and long numbers give way to place-holders. An address begins where its run of
#: characters does, so a long run without an address is looked at once.
REDACTIONS = ((re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"), "<EMAIL>"), (re.compile(r"\+?\d(?:[ ().-]?\d){6,}"), "<NUMBER>"))


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits of text, the last first, so that the places of those to come hold. Of two that overlap the address holds, or else the earlier."""
    found = sorted((m.start(), rank, m.end(), instead) for rank, (pattern, instead) in enumerate(REDACTIONS) for m in pattern.finditer(text))
    out: list[tuple[int, int, int, str]] = []
    for start, rank, end, instead in found:
        if out and start < out[-1][2]:
            if rank < out[-1][1]:
                out[-1] = (start, rank, end, instead)
            continue
        out.append((start, rank, end, instead))
    return [(start, end, instead) for start, _, end, instead in reversed(out)]


def trees(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text, lens, tokens: every document's words, as their lengths in code points, and their numbers of tokens."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        table = WordIds(path)
        for ids, texts in rows(batches, 2 << 20):
            _, per, n, words = table.encode(texts, keep=True)
            lens = np.fromiter(map(len, chain.from_iterable(words)), np.int32, len(per))
            at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.ListArray.from_arrays(at, pa.array(lens)), pa.ListArray.from_arrays(at, pa.array(per.astype(np.int32)))], ["doc_id", "text", "lens", "tokens"])

    return two(docs).mapInArrow(run, TREE)


def edited(stored: DataFrame, edits: Callable[[str], list] | DataFrame, vocabulary: str | None = None, keep: bool = True) -> DataFrame:
    """The trees after the edits (with keep), and the counts: n_words and n_tokens_before of the stored tree, n_edits, n_chars and n_tokens
    after them, reencoded_chars.

    edits is a function from a text to its edits in the order in which they are applied, or a table of doc_id, seq, start, end and
    replacement, applied in order of seq (ties by start, end and replacement). One document's edits meet in one row.
    """
    path = vocabulary or default_vocabulary()
    if isinstance(edits, DataFrame):
        lists = edits.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("edits"))
        stored, found = stored.select("doc_id", "text", "lens", "tokens").join(lists, "doc_id", "left"), None
    else:
        stored, found = stored.select("doc_id", "text", "lens", "tokens"), edits

    def run(batches):
        encoder = WordIds(path)
        for batch in batches:
            b = dict(zip(batch.schema.names, batch.columns))
            lens, tokens = b["lens"], b["tokens"]
            flat_lens, flat_tokens, at = lens.values.to_numpy(), tokens.values.to_numpy(), lens.offsets.to_numpy()
            total = np.concatenate([[0], np.cumsum(flat_tokens, dtype=np.int64)])
            starts = tokens.offsets.to_numpy()
            got, after = [], []
            for k, (i, text) in enumerate(zip(b["doc_id"].to_pylist(), b["text"])):
                text = text.as_py() or ""
                n, before = int(at[k + 1] - at[k]), int(total[starts[k + 1]] - total[starts[k]])
                todo = [(e["start"] or 0, e["end"] or 0, e["replacement"] or "") for e in b["edits"][k].as_py() or []] if found is None else found(text)
                if not todo:
                    got.append((i, n, before, 0, len(text), before, 0))
                    if keep:
                        after.append((text, flat_lens[at[k] : at[k + 1]], flat_tokens[starts[k] : starts[k + 1]]))
                    continue
                tree = CountTree.load(text, flat_lens[at[k] : at[k + 1]], flat_tokens[starts[k] : starts[k + 1]], encoder)
                for e in todo:
                    tree.edit(*e)
                got.append((i, n, before, len(todo), tree.n_chars, tree.n_tokens, tree.reencoded))
                if keep:
                    after.append((tree.text(), [len(w) for w in tree.each_word()], [t for block in tree.tokens for t in block]))
            if got:
                columns = [pa.array(c, pa.int64()) for c in zip(*got)]
                if keep:
                    columns += [pa.array(c, kind) for c, kind in zip(zip(*after), (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, *(("text", "lens", "tokens") if keep else ())])

    return stored.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in COUNTS) + (", text string, lens array<int>, tokens array<int>" if keep else ""))


def counted(docs: DataFrame, edits: Callable[[str], list] | DataFrame = redactions, vocabulary: str | None = None) -> DataFrame:
    """Store every document's tree, then apply the edits to the stored trees: doc_id and the counts."""
    return edited(staged(trees(docs, vocabulary), "trees"), edits, vocabulary, keep=False)
