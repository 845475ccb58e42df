"""Operator 1, media columns: baseline JPEG.

A byte string becomes one or more baseline JPEG images of 64 blocks a row. Each byte is the mean of one 8x8 block: with a DC
quantiser of 8 the quantised DC coefficient is exactly byte - 128, so the DC-only thumbnail (one sample a block) is the payload. Differences of
neighbours have Huffman codes of 3 to 15 bits, and each row of blocks is a restart interval.
The reader parses markers, Huffman-decodes the scan and rebuilds the DC-only luminance thumbnail in numpy: all restart intervals of a batch of images
in step, a block of each at a time. Baseline images of other writers (several components, sampling factors, AC coefficients) are decoded symbol by
symbol, in linear time.

Null text counts as empty; an empty text has a payload of 64 zero bytes. Very long texts become several images, one after the
other, so that no side exceeds the format's 65,535 samples. Equal texts give equal values. A null id stays null, repeated rows are repeated, an empty
table gives an empty one. Media that are no whole baseline images of one scan (progressive, cut off, null) have null digests and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import two

ACROSS = 64  # blocks in a row, so bytes in a row of the thumbnail
ROWS = 8128  # rows of blocks in one image at most
MARK = b"\xff"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


#: How many codes of each length the DC table has, for the categories from 0 on (fixed values of the format's example).
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_TABLE, AC_TABLE = (DC_COUNTS, bytes(range(12))), (bytes([1] + [0] * 15), b"\0")  # of AC, only the end of a block


@lru_cache(1)
def _own_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and number of bits of a whole block by DC difference + 255: the category, the difference's bits, the end of the block."""
    sizes = [n for n, k in enumerate(DC_COUNTS, 1) for _ in range(k)]
    codes, at = [], 0
    for k, n in enumerate(sizes):
        at <<= n - (sizes[k - 1] if k else n)
        codes.append(at)
        at += 1
    code, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code[d + 255] = ((codes[c] << c) | (d if d > 0 else d + (1 << c) - 1)) << 1  # the end of the block is 0
        size[d + 255] = sizes[c] + c + 1
    return code, size


def _scan(values: np.ndarray) -> bytes:
    """Entropy-coded rows of blocks with restart markers between them."""
    code, size = _own_codes()
    v = values.reshape(-1, ACROSS).astype(np.int64) - 128
    d = np.diff(v, axis=1, prepend=0) + 255
    code, size = code[d], size[d]
    ends = np.cumsum(size, axis=1)
    n_bytes = (ends[:, -1] + 7) >> 3
    first = np.cumsum(n_bytes) - n_bytes
    at = (first[:, None] * 8 + ends - size).ravel()
    word = code.ravel() << (24 - size.ravel() - (at & 7))  # a code lies in three bytes
    at >>= 3
    total = int(n_bytes.sum())
    out = sum(np.bincount(at + k, (word >> (16 - 8 * k)) & 255, total + 2) for k in range(3))[:total].astype(np.uint8)
    last = first + n_bytes - 1
    out[last] |= ((1 << (n_bytes * 8 - ends[:, -1])) - 1).astype(np.uint8)  # ones to the end of the byte
    full = (out == 255).astype(np.int64)  # is followed by a zero
    place = np.arange(total) + np.cumsum(full) - full + 2 * np.repeat(np.arange(len(v)), n_bytes)
    scan = np.zeros(total + int(full.sum()) + 2 * (len(v) - 1), np.uint8)
    scan[place] = out
    marks = (place[last] + 1 + full[last])[:-1]
    scan[marks], scan[marks + 1] = 0xFF, 0xD0 + np.arange(len(marks)) % 8
    return scan.tobytes()


def _one_image(values: np.ndarray) -> bytes:
    h = len(values) // ACROSS
    huffman = b"".join(_segment(0xC4, bytes([kind]) + counts + symbols) for kind, (counts, symbols) in ((0x00, DC_TABLE), (0x10, AC_TABLE)))
    frame = struct.pack(">BHHB", 8, h * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0])
    head = _segment(0xDB, bytes([0, 8, *[1] * 63])) + _segment(0xC0, frame) + huffman + _segment(0xDD, struct.pack(">H", ACROSS))
    return b"\xff\xd8" + head + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + _scan(values) + b"\xff\xd9"


def encode(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as JPEG images."""
    if not payload or len(payload) % ACROSS:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    values, step = np.frombuffer(payload, np.uint8), ACROSS * ROWS
    return b"".join(_one_image(values[i : i + step]) for i in range(0, len(values), step))


class _Huffman:
    """A table of the format as (length, symbol) by 16 bits of look-ahead."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol, self.sizes = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8), {}
        code = at = 0
        for length, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.length[code << (16 - length) : (code + 1) << (16 - length)] = length
                self.symbol[code << (16 - length) : (code + 1) << (16 - length)] = s
                self.sizes[s] = length
                code += 1
            at += n
            code <<= 1


@lru_cache(64)
def _table(counts: bytes, symbols: bytes) -> _Huffman:
    return _Huffman(counts, symbols)


@lru_cache(64)
def _blocks(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """By 16 bits of look-ahead: the bits of a block that is a DC difference and nothing else (0 where it isn't, or is longer), and the difference."""
    dc_table, ac_table = _table(*dc), _table(*ac)
    window = np.arange(1 << 16, dtype=np.int64)
    c, size = dc_table.symbol.astype(np.int64), dc_table.length.astype(np.int64)
    after = (window << np.minimum(size + c, 16)) & 0xFFFF
    total = size + c + ac_table.length[after]
    whole = (size > 0) & (size + c < 16) & (ac_table.length[after] > 0) & (ac_table.symbol[after] == 0) & (total <= 16)
    extra = (window >> np.maximum(16 - size - c, 0)) & ((1 << c) - 1)
    diff = np.where(c == 0, 0, np.where(extra >> np.maximum(c - 1, 0), extra, extra - (1 << c) + 1))
    return np.where(whole, total, 0).astype(np.int64), diff


def _in_step(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """DC values of blocks (intervals by blocks) of restart intervals that start at these bytes, one block of each at a time; and which hold other blocks."""
    bits, diff = tables
    ahead = np.concatenate([data, np.full(3, 255, np.uint8)]).astype(np.int32)
    ahead = (ahead[:-2] << 16) | (ahead[1:-1] << 8) | ahead[2:]
    by = np.argsort(-counts, kind="stable")
    at, most = starts[by].astype(np.int64) * 8, int(counts.max(initial=0))
    out, odd = np.zeros((len(by), most), np.int64), np.zeros(len(by), bool)
    live = np.searchsorted(-counts[by], -np.arange(most), "left")  # intervals with more than so many blocks
    for k in range(most):
        n = int(live[k])
        here = at[:n]
        window = (ahead[np.minimum(here >> 3, len(ahead) - 1)] >> (8 - (here & 7))) & 0xFFFF
        step = bits[window]
        odd[:n] |= step == 0
        out[:n, k] = diff[window]
        at[:n] += step
    back = np.argsort(by, kind="stable")
    return np.cumsum(out, axis=1)[back], odd[back]


def _general(data: np.ndarray, starts: np.ndarray, comps: list[dict], mcus: int, interval: int) -> None:
    """Fill each component's list of quantised DC values, in scan order, from restart intervals with any tables, symbol by symbol."""
    done, raw = 0, data.tobytes()
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(raw)]):
        held = size = 0
        left, at, last = interval or mcus, start, {id(c): 0 for c in comps}

        def more(k: int) -> int:
            """The next k bits, without taking them; ones beyond the end."""
            nonlocal held, size, at
            while size < k:
                if at > stop + 8:
                    raise ValueError("the scan ends early")
                held = ((held << 8) | (raw[at] if at < stop else 255)) & 0xFFFFFFFF
                at, size = at + 1, size + 8
            return (held >> (size - k)) & ((1 << k) - 1)

        def symbol(table) -> int:
            nonlocal size
            w = more(16)
            if not table.length[w]:
                raise ValueError("no such code")
            size -= int(table.length[w])
            return int(table.symbol[w])

        while left and done < mcus:
            for c in comps:
                for _ in range(c["h"] * c["v"] if len(comps) > 1 else 1):
                    if k := symbol(c["dc"]):
                        x = more(k)
                        size -= k
                        last[id(c)] += x if x >> (k - 1) else x - (1 << k) + 1
                    c["values"].append(last[id(c)])
                    z = 1
                    while z < 64:
                        run, k = divmod(symbol(c["ac"]), 16)
                        if not k and run < 15:
                            break
                        more(k)
                        size -= k
                        z += run + 1
            done, left = done + 1, left - 1
    if done < mcus:
        raise ValueError("the scan ends early")


def _parsed(media: bytes) -> Iterator[dict]:
    """Each baseline image in media: its frame, tables, and its scan's bytes with the starts of its restart intervals."""
    at = 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        quant, huff, interval, frame = {}, {}, 0, {}
        while True:
            while media[at + 1] == 0xFF:  # fill bytes
                at += 1
            kind, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif kind == 0xC0:
                _, height, width, n = struct.unpack_from(">BHHB", body)
                frame = {body[6 + 3 * i]: {"h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i], "values": []} for i in range(n)}
            elif kind in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("only baseline images are read")
            elif kind == 0xDA:
                break
        comps = []
        for i in range(body[0]):
            c = frame[body[1 + 2 * i]]
            c["dc_raw"], c["ac_raw"] = huff[body[2 + 2 * i] >> 4], huff[0x10 | (body[2 + 2 * i] & 15)]
            comps.append(c)
        raw = np.frombuffer(media, np.uint8, offset=at)
        full = np.flatnonzero(raw[:-1] == 255)
        after = raw[full + 1]
        restart = (after & 0xF8) == 0xD0
        end = full[(after != 0) & ~restart][:1]
        if not len(end) or raw[end[0] + 1] != 0xD9 or len(comps) < len(frame):
            raise ValueError("a baseline image has one whole scan here")
        inner = full < end[0]
        full, after, restart = full[inner], after[inner], restart[inner]
        keep = np.ones(end[0], bool)
        keep[full[after == 0] + 1] = False
        marks = full[restart]
        keep[marks] = keep[marks + 1] = False
        starts = np.concatenate([[0], np.cumsum(keep)[marks]]).astype(np.int64)
        yield {"width": width, "height": height, "comps": comps, "interval": interval, "quant": quant, "data": raw[: end[0]][keep], "starts": starts}
        at += int(end[0]) + 2


def _sides(image: dict) -> tuple[int, int]:
    """Rows and columns of luminance blocks that the picture covers."""
    y = image["comps"][0]
    hm, vm = max(c["h"] for c in image["comps"]), max(c["v"] for c in image["comps"])
    return -(-image["height"] * y["v"] // (8 * vm)), -(-image["width"] * y["h"] // (8 * hm))


def _by_symbol(image: dict) -> np.ndarray:
    comps, (high, wide) = image["comps"], _sides(image)
    for c in comps:
        c["dc"], c["ac"] = _table(*c["dc_raw"]), _table(*c["ac_raw"])
    y = comps[0]
    hm, vm = max(c["h"] for c in comps), max(c["v"] for c in comps)
    across, down = (-(-image["width"] // (8 * hm)), -(-image["height"] // (8 * vm))) if len(comps) > 1 else (wide, high)
    _general(image["data"], image["starts"], comps, across * down, image["interval"])
    values = np.array(y["values"], np.int64)
    if len(comps) > 1:
        values = values.reshape(down, across, y["v"], y["h"]).transpose(0, 2, 1, 3).reshape(down * y["v"], across * y["h"])
    return values.reshape(-1, wide)[:high] if len(comps) == 1 else values[:high, :wide]


def all_thumbnails(many: list[bytes | None]) -> list[list[np.ndarray] | None]:
    """The DC-only luminance thumbnails (rows, columns) of the images in each of many media; None for media that can't be read."""
    images: list[list[dict] | None] = []
    for media in many:
        try:
            images.append(list(_parsed(media)) if media else None)
        except (ValueError, IndexError, KeyError, struct.error):
            images.append(None)
    alike: dict[tuple, list[tuple[dict, np.ndarray]]] = {}
    for image in (x for some in images if some for x in some):
        high, wide = _sides(image)
        counts = np.full(len(image["starts"]), image["interval"] or high * wide)
        counts[-1] = high * wide - (len(counts) - 1) * counts[0]
        if len(image["comps"]) == 1 and counts[-1] > 0 and (image["interval"] or len(counts) == 1):
            alike.setdefault((image["comps"][0]["dc_raw"], image["comps"][0]["ac_raw"]), []).append((image, counts))
    for tables, some in alike.items():
        at = np.cumsum([0, *(len(x["data"]) for x, _ in some)])
        starts = np.concatenate([x["starts"] + a for (x, _), a in zip(some, at.tolist())])
        values, odd = _in_step(np.concatenate([x["data"] for x, _ in some]), starts, np.concatenate([n for _, n in some]), _blocks(*tables))
        k = 0
        for x, n in some:
            if not odd[k : k + len(n)].any():
                mine = values[k : k + len(n)]
                x["dc"] = (mine[:, : n[0]] if (n == n[0]).all() else mine[np.arange(mine.shape[1]) < n[:, None]]).reshape(_sides(x))
            k += len(n)
    out: list[list[np.ndarray] | None] = []
    for some in images:
        try:
            thumbs = [] if some else None
            for x in some or []:
                dc = x["dc"] if "dc" in x else _by_symbol(x)
                thumbs.append(np.clip((dc * x["quant"][x["comps"][0]["q"]] + 4) // 8 + 128, 0, 255).astype(np.uint8))
            out.append(thumbs)
        except (ValueError, IndexError, KeyError):
            out.append(None)
    return out


def thumbnails(media: bytes) -> list[np.ndarray]:
    """The thumbnails of the images in one medium; ValueError if it can't be read."""
    (found,) = all_thumbnails([media])
    if found is None:
        raise ValueError("only whole baseline images of one scan are read")
    return found


def decode(media: bytes) -> bytes:
    """The payload that encode() stored."""
    return b"".join(t.tobytes() for t in thumbnails(media))


def feature(thumbs: list[np.ndarray]) -> str:
    """Width and height in samples of the images, one under the other, and a 64-bit average hash of the thumbnail."""
    t = thumbs[0] if len(thumbs) == 1 else np.concatenate(thumbs)
    h, w = t.shape
    lines = np.zeros((h + 1, 8), np.int64)
    np.cumsum(np.add.reduceat(t, np.arange(8) * w // 8, axis=1, dtype=np.int64) if w >= 8 else np.repeat(t[:, :1].astype(np.int64), 8, 1), axis=0, out=lines[1:])
    low = np.arange(8) * h // 8
    high = np.maximum((np.arange(8) + 1) * h // 8, low + 1)
    cells = (lines[high] - lines[low]) / (high - low)[:, None]
    return f"{w * 8}x{h * 8}:{int.from_bytes(np.packbits(cells >= cells.mean()).tobytes(), 'big'):016x}"


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int64()), ("height", pa.int64())])


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as baseline JPEG, one pass over the rows."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, out, sizes, total = 0, [], [], 0
            for i in range(batch.num_rows):
                p = payload_of(t := texts[i].as_py())
                sizes.append(len(t.encode()) if t else 0)
                out.append(encode(p))
                total += len(out[-1])
                if total > 8 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(start, i + 1 - start), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "media"])
                    start, out, sizes, total = i + 1, [], [], 0

    return two(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Digests and thumbnail features of stored media, all read back from the stored bytes."""

    def rows_of(ids, sizes, stored):
        for i, n, m, thumbs in zip(ids, sizes, stored, all_thumbnails(stored)):
            if thumbs is None:
                yield (i, n, None, None, None, None if m is None else len(m), None if m is None else hashlib.sha256(m).hexdigest(), None, None, None)
                continue
            p = b"".join(t.tobytes() for t in thumbs)
            yield (i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(thumbs), thumbs[0].shape[1] * 8, sum(t.shape[0] for t in thumbs) * 8)

    def run(batches):
        for batch in batches:
            ids, sizes, media_ = batch.columns
            start = held = 0
            for k in range(batch.num_rows):  # some megabytes at a time
                held += len(media_[k].as_buffer()) if media_[k].is_valid else 0
                if held >= 2 << 20 or k + 1 == batch.num_rows:
                    part = slice(start, k + 1)
                    got = list(rows_of(ids[part].to_pylist(), sizes[part].to_pylist(), media_[part].to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), SCHEMA)], schema=SCHEMA)
                    start, held = k + 1, 0

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")


def media_columns(docs: DataFrame) -> DataFrame:
    return features(with_media(docs))
