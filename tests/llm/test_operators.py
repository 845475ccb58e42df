"""Each operator against brute force, an exact round trip or held-out accuracy, with the awkward rows in every table."""

import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quillspark.llm import bpe, counts, html, langid, media, mixing, quality, simhash, token_store, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, i int, n string"
LONG = "The quick brown fox said , and then it went on over the hill . " * 900
BASE = " ".join(f"word{i} of text" for i in range(80))
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("word7 ", "other "), "en", "b"), (4, None, None, None), (5, "", "fr", "b"), (6, LONG, "en", "a"), (7, "a  b\n\n\nc <|endoftext|> don't \x1c x\x85y", "en", "c"),
    (8, "  héé 日本語　テ 🙂 ok\t\tz  ", None, "c"), (9, "# * $ | line\nline\nline\n" * 30, "en", ""), (10, "one two", "en", "a"), (11, "SHOUT!! LOUD!! " * 60, "en", "b"), (12, BASE, "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "clash", 1, "x") for r in ROWS], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def by_id(df):
    got = df.collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    return {r["doc_id"]: r for r in got}


@pytest.mark.parametrize("f", [lambda d: html.extracted(d.selectExpr("doc_id AS page_id", "text AS html", "source AS url")), lambda d: toxicity.toxicity(d, d.selectExpr("doc_id", "i AS quality", "i AS toxic")), media.media_columns, token_store.stored_tokens, bpe.encode_decode, quality.quality, counts.counted, simhash.near_dedup, mixing.mix, langid.languages])
def test_empty_tables(empty, f):
    assert f(empty).count() == 0


@pytest.mark.parametrize("f", [quality.kept, langid.kept, simhash.deduplicated, mixing.mixed_rows])
def test_stages_keep_columns(docs, empty, f):
    assert f(docs).columns == docs.columns
    assert f(empty).count() == 0


def test_media(docs):
    got = by_id(media.media_columns(docs))
    for i, t, *_ in ROWS:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[1]["media_sha256"] == got[2]["media_sha256"] and got[1]["feature"] == got[2]["feature"] != got[3]["feature"]


class Writer:
    """Another writer's baseline image: three components, luminance twice as fine, restarts, AC coefficients, tables of its own."""

    DC = {s: format(k, "04b") for k, s in enumerate(range(12))}
    AC = {s: format(k, "05b") for k, s in enumerate([0x00, 0xF0, 0x01, 0x11, 0x23, 0x52, 0x0A])}

    def __init__(self, rng, across, down, interval):
        self.rng, self.dc = rng, []
        segment = lambda kind, body: struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body
        table = lambda kind, codes, length: bytes([kind]) + bytes([len(codes) if n == length else 0 for n in range(1, 17)]) + bytes(codes)
        frame = struct.pack(">BHHB", 8, down * 16 - 3, across * 16 - 5, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        head = segment(0xE0, b"other") + segment(0xDB, bytes([0] + [8] * 64)) + segment(0xC0, frame) + segment(0xC4, table(0x00, self.DC, 4) + table(0x10, self.AC, 5)) + segment(0xDD, struct.pack(">H", interval))
        scan, bits, last = b"", "", [0, 0, 0]
        for m in range(across * down):
            if m and m % interval == 0:
                scan, bits, last = scan + self.bytes(bits) + bytes([0xFF, 0xD0 + (m // interval - 1) % 8]), "", [0, 0, 0]
            for c in (0, 0, 0, 0, 1, 2):
                value = rng.randrange(-100, 101)
                bits, last[c] = bits + self.block(value - last[c]), value
                if c == 0:
                    self.dc.append(value)
        self.media = b"\xff\xd8" + head + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + self.bytes(bits) + b"\xff\xd9"
        grid = np.array(self.dc).reshape(down, across, 2, 2).transpose(0, 2, 1, 3).reshape(down * 2, across * 2)
        self.thumbnail = np.clip(grid[: -(-(down * 16 - 3) // 8), : -(-(across * 16 - 5) // 8)] + 128, 0, 255)

    def number(self, v):
        n = abs(v).bit_length()
        return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def block(self, diff):
        out, z = self.DC[abs(diff).bit_length()] + self.number(diff), 1
        while z < 50 and self.rng.random() < 0.6:
            symbol = self.rng.choice([0xF0, 0x01, 0x11, 0x23, 0x52, 0x0A])
            run, size = divmod(symbol, 16)
            if z + run > 62:
                break
            out, z = out + self.AC[symbol] + "1" * size, z + run + 1
        return out + self.AC[0]

    def bytes(self, bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 2), (7, 4, 100)])
def test_media_of_another_writer(shape):
    w = Writer(random.Random(sum(shape)), *shape)
    own = media.encode(bytes(64))
    (got,), (both_a, both_b) = media.thumbnails(w.media), media.thumbnails(w.media + own)
    assert (got == w.thumbnail).all() and (both_a == got).all() and both_b.tobytes() == bytes(64)


def test_media_that_cannot_be_read(spark):
    whole = media.encode(bytes(range(64)))
    progressive = whole.replace(b"\xff\xc0", b"\xff\xc2", 1)
    data = [(1, 64, whole), (2, 0, progressive), (3, 0, whole[:-40]), (4, 0, None), (5, 0, b"text"), (None, 64, whole)]
    d = spark.createDataFrame([(i, n, None if m is None else bytearray(m)) for i, n, m in data], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.features(d).collect()}
    assert got[1]["payload_sha256"] == hashlib.sha256(bytes(range(64))).hexdigest() == got[None]["payload_sha256"]
    assert all(got[i]["payload_sha256"] is None and got[i]["feature"] is None for i in (2, 3, 4, 5)) and got[4]["media_sha256"] is None


@pytest.mark.parametrize("n", [64, 640, 64 * 8128, 64 * 8128 + 64])
def test_media_round_trip(n):
    p = random.Random(n).randbytes(n)
    assert media.decode(media.encode(p)) == p


def test_media_codes_differ_in_length():
    assert len(media.encode(b"a" * 6400)) < len(media.encode(random.Random(1).randbytes(6400))) / 3


def test_encodings(docs, library):
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in ROWS}
    got, stored, start = by_id(bpe.encode_decode(docs, keep_ids=True, chunk=2000)), by_id(token_store.stored_tokens(docs)), 0
    for i in sorted(ids):
        text = library.decode(ids[i], skip_special_tokens=False)
        assert (got[i]["n_tokens"], list(got[i]["ids"]), got[i]["decoded"]) == (len(ids[i]), ids[i], text)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        all_ = [*ids[i], 0]
        assert (stored[i]["start"], stored[i]["n_tokens"], stored[i]["ids_crc32"]) == (start, len(all_), zlib.crc32(struct.pack(f"<{len(all_)}I", *all_)))
        start += len(all_)


def test_repeated_and_null_ids(spark, library, tmp_path):
    """Rows with one id, and without one: starts follow the files, no row is lost, and each operator has a row for each."""
    texts = ["one two three", "a", None, "one two three", "b " * 50, "", "zz", "a"]
    ids = [5, 5, None, 5, None, 2, 7, 5]
    d = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    token_store.write(d, str(tmp_path / "t"), partitions=3)
    stored = token_store.read(spark, str(tmp_path / "t"))
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.digests(stored).collect()))
    assert [g[0] for g in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert [g[1] for g in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = sorted(zlib.crc32(struct.pack(f"<{len(a)}I", *a)) for a in ([*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts))
    assert sorted(g[3] for g in got) == want
    for f in (bpe.encode_decode, quality.quality, counts.counted, simhash.near_dedup, mixing.mix, media.media_columns):
        rows = f(d.selectExpr("*", "'s' AS source")).collect()
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((i is not None, i or 0) for i in ids), f
    langs = langid.languages(d.selectExpr("*", "'en' AS lang")).collect()
    assert len(langs) == len(ids) and all(not r["held_out"] for r in langs if r["doc_id"] is None)


def test_token_files_prune(spark, tmp_path):
    """Files are in order of ids, so a file's statistics shut out ids; Bloom filters on doc_id are there; ids come back whole."""
    import pyarrow.orc as orc

    d = spark.range(4000).selectExpr("id * 3 AS doc_id", "concat('text ', id) AS text").repartition(5)
    token_store.write(d, str(tmp_path / "t"), partitions=4)
    bounds = []
    for f in sorted((tmp_path / "t").glob("part-*")):
        t = orc.ORCFile(str(f))
        ids = t.read(columns=["doc_id"]).column(0).to_pylist()
        bounds.append((ids[0], ids[-1]))
        assert ids == sorted(ids) and t.nstripes >= 1
    assert all(a[1] < b[0] for a, b in itertools.pairwise(bounds)) and len(bounds) == 4
    options = spark.read.schema("doc_id long, ids array<int>").orc(str(tmp_path / "t"))
    q = options.where("doc_id = 3000")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3000)]" in q._jdf.queryExecution().toString() and q.count() == 1
    assert options.where("doc_id = 3001").count() == 0


def test_trees_are_stored_and_edited_again(spark, library, tmp_path):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["foo", "bar,", "日本", "x1", "\n\n", "don't"]) for _ in range(rng.randint(0, 300))) for i in range(30)}
    d = spark.createDataFrame([*texts.items(), (None, "no id"), (3, texts[3])], "doc_id long, text string")
    first = [(i, k, a := rng.randint(0, 400), a + rng.randint(0, 9), rng.choice(["", "new words ", "é"])) for i in range(0, 30, 3) for k in range(3)]
    second = [(i, 0, 5, 8, "again") for i in range(0, 30, 2)]
    kind = "doc_id long, seq int, start int, end int, replacement string"
    stored = counts.trees(d)
    for some in (first, second):
        after = counts.edited(stored, spark.createDataFrame(some, kind))
        after.write.parquet(path := str(tmp_path / str(len(some))))
        stored = spark.read.parquet(path)
        for i, _, a, z, new in sorted(some):
            t = texts[i]
            a, z = min(a, len(t)), min(z, len(t))
            texts[i] = t[:a] + new + t[z:]
    got = stored.collect()
    assert len(got) == 32 and {r["text"] for r in got if r["doc_id"] is None} == {"no id"}
    for r in got:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]]
            assert r["text"] == t and r["n_chars"] == len(t) == sum(r["lens"]) and r["n_tokens"] == sum(r["tokens"]) == len(library.encode(t, add_special_tokens=False).ids)
    assert sum(r["reencoded_chars"] for r in got) < sum(map(len, texts.values()))


def test_long_texts_are_read_in_linear_time(spark):
    """A run of letters, digits, unclosed elements: each was quadratic once."""
    import time

    began = time.time()
    assert counts.redactions("a" * 300_000) == [] and len(counts.redactions("1234567 x@y.zz " * 10_000)) == 20_000
    assert html.main_text("<div>x" * 20_000).count("x") == 20_000
    assert sum(map(len, langid.words_of("word " * 300_000))) == 300_000
    model = langid.Model(["a", "b"], np.zeros((langid.BINS, 2), np.float32), np.ones((langid.N_SCRIPTS, 2), bool))
    assert len(langid.labelled(model, ["word other " * 200_000])[0][2]) == 400_000
    assert time.time() - began < 60


def test_numerals_are_no_letters():
    assert langid.WORD.findall("½ ² Ⅷ ab½c") == ["ab", "c"] and langid.labelled(langid.Model(["a"], np.zeros((langid.BINS, 1), np.float32), np.ones((langid.N_SCRIPTS, 1), bool)), ["½ ²"])[0][0] == "und"


def test_white_space_that_libraries_differ_in(library):
    rng, b = random.Random(3), bpe.bpe(bpe.default_vocabulary())
    letters = [*bpe.MAYBE_WHITE, *"abc.,'s12éπ日", *[" "] * 10]
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        assert [i for w in b.words(t) for i in b.ids(w)] == library.encode(t, add_special_tokens=False).ids
        assert b.whole(t) in (None, library.encode(t, add_special_tokens=False).ids)


def test_edits(library):
    rng, encoder = random.Random(1), counts.WordIds(bpe.default_vocabulary())
    bits = [" ", "  ", "\n", "\n\n", "a", "foo", "bar,", "'s", "é", " x", "12", "<|endoftext|>", "<|", "|>", "\t", "日本", "!!", "don't"]
    for k in range(400):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 400 if k % 40 == 0 else 12)))
        _, per, _, (words,) = encoder.encode([s], keep=True)
        tree = counts.CountTree(words, per, encoder)
        for _ in range(4):
            a = rng.randint(0, len(s) + 1)
            b, new = rng.randint(a, a + rng.choice([0, 1, 3, 50])), "".join(rng.choice(bits) for _ in range(rng.randint(0, 3)))
            tree.edit(a, b, new)
            s = s[:a] + new + s[b:]
            assert tree.text() == s and tree.n_tokens == len(library.encode(s, add_special_tokens=False).ids)


def test_counted(docs, spark, library):
    text = BASE + " mail jane.doe@example.org or +1 555 123 4567 now"
    d = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = by_id(counts.counted(d))
    after = text.replace("jane.doe@example.org", "<EMAIL>").replace("+1 555 123 4567", "<NUMBER>")
    assert (got[1]["n_edits"], got[1]["n_tokens"], got[1]["n_chars"]) == (2, len(library.encode(after).ids), len(after)) and got[1]["reencoded_chars"] < len(text) / 4
    assert got[2]["n_tokens"] == 0


def test_quality_rules(docs):
    got = by_id(quality.quality(docs))
    for i, t, *_ in ROWS:
        blanks = " \t\n\x0b\x0c\r"
        w = "".join(" " if c in blanks else c for c in t or "").split(" ")
        w = [x for x in w if x]
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = {x for x in tri if tri.count(x) > 1} if len(tri) < 1000 else {x for x, g in itertools.groupby(sorted(tri)) if len(list(g)) > 1}
        covered = {k + o for k, x in enumerate(tri) if x in seen for o in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(blanks)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)), i
        assert r["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w)) and (not r["kept"] or not r["base_failed"])
    assert got[1]["kept"] and not got[4]["kept"] and not got[11]["kept"]
    assert sorted(r["doc_id"] for r in quality.kept(docs).collect()) == sorted(i for i, r in got.items() if r["kept"])


def test_cascade_order():
    rules = [quality.Rule(n, None, None) for n in "abc"]
    seen = [[True, True, False, 100, 1, 1], [False, True, False, 100, 1, 1], [True, False, True, 100, 1, 1]]
    assert quality.order(rules, seen) == [1, 2, 0] and quality.order(rules, []) == [0, 1, 2]


def brute_components(fps, far=2):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= far:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_simhash(docs):
    got, fps = by_id(simhash.near_dedup(docs)), {}
    for i, t, *_ in ROWS:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    want = brute_components(fps)
    assert {i: (int(r["fingerprint"], 16), r["component_id"]) for i, r in got.items()} == {i: (fps[i], want[i]) for i in fps}
    assert got[4]["component_id"] == got[5]["component_id"] == 4


def test_one_row_of_each_component(spark):
    """Repeated rows, ids with two texts, and null ids."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    data = [(1, a, "x"), (1, a, "x"), (2, a, "x"), (1, b, "y"), (3, b, "y"), (None, c, "z"), (None, c, "z"), (4, c, "z"), (None, d, "u"), (None, d, "u"), (None, e, "v")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    got = sorted((tuple(r) for r in simhash.deduplicated(docs).collect()), key=lambda r: r[1])
    assert got == [(1, a, "x"), (1, b, "y"), (4, c, "z"), (None, d, "u"), (None, e, "v")]


def test_near_copies(spark):
    """Planted near copies, a group of many, and a line that all share, against all pairs."""
    rng = random.Random(11)
    base = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [None, "", "one two"]
    for _ in range(25):
        w = base(rng.randint(30, 300))
        for _ in range(3):
            v = list(w)
            for _ in range(rng.choice([1, 1, 2, 3, 6])):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    hot = base(200)
    texts += [" ".join([*hot[:k], f"x{k}", *hot[k + 1 :]]) for k in range(60)]
    texts += ["the same line in very many texts " * 2 + " ".join(base(rng.randint(0, 8))) for _ in range(40)]
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in enumerate(texts)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(d).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) < len(texts) - 60
    assert simhash.deduplicated(d).count() == len(set(got.values()))


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """The stage's first candidates are those of the ring; without any of the prefixes they alone link what lies within two bits and is similar."""
    rng, texts = random.Random(17), [None, "", "one two", "one two three"]
    for n in (40, 400, 1500):
        for _ in range(4):
            w = [f"w{rng.randrange(3000)}" for _ in range(n)]
            for k in range(4):
                v = list(w)
                v[rng.randrange(n)] = f"changed{k}"
                texts.append(" ".join(v))
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in enumerate(texts)}
    h = {i: [xxhash.xxh64_intdigest(x, 42) for x in s] for i, s in sets.items()}
    fps = {i: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h[i]) > len(h[i])) for i in sets}
    within = [(a, b) for a, b in itertools.combinations(sets, 2) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    assert len(within) > 20 and all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in within)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    classes = spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in fps.items()], "id long, fp long")
    pairs = {(r["b"], r["a"]) for r in simhash.ringed(classes).collect()}
    assert pairs <= set(within)
    monkeypatch.setattr(simhash, "_may", lambda similarity: simhash.F.lit(False))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(d).collect()}
    assert got == brute_components(fps) and len(set(got.values())) < len(texts) - 12


@pytest.mark.parametrize("short", [1, 4, 32])
def test_links_and_components(spark, short):
    rng, fps = random.Random(5), set()
    for _ in range(60):  # chains of values that differ in up to three bits
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    values = [int(v) for v in np.array(sorted(fps), np.uint64).view(np.int64)]
    d = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r["a"]: r["root"] for r in simhash.components(simhash.linked(d, short)).collect()}
    want = brute_components({v: v & (1 << 64) - 1 for v in values})
    assert {v: got.get(v, v) for v in values} == want


def test_mixing_large_source_of_low_weight(spark):
    """Most of a source's queue lies beyond the budget and a third of the rows have no words; SQL without buckets must agree."""
    import duckdb

    data = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "big") for i in range(600)] + [(1000 + i, None if i % 2 else " ", "void") for i in range(400)]
    data += [(2000 + i, "a b c d " * 10, f"s{i % 29:02d}") for i in range(290)] + [(3000, "x " * 5000, "a"), (3001, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = sorted(tuple(r) for r in mixing.mix(docs).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", data)
    want = sorted(con.execute(mixing.ORACLE_SQL).fetchall())
    assert got == want
    assert 0 < sum(r[4] for r in got if r[0] < 600) < sum(r[1] for r in got if r[0] < 600) / 4


def test_mixing_equal_ids(spark):
    """A third of the rows have no id, a third the same one: their texts deal them out, and the files' order changes nothing."""
    data = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "word " * (1 + i % 11) + str(i), "abc"[i % 2]) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    queued = mixing.queue(mixing.sized(docs)).where("round = 0")
    assert max(r["count"] for r in queued.groupBy("source", "bucket").count().collect()) <= 8
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"])
    assert sorted(mixing.mixed_rows(docs.repartition(5, "text")).collect(), key=key) == sorted(mixing.mixed_rows(docs.coalesce(1)).collect(), key=key)


def test_mixing(docs):
    got = by_id(mixing.mix(docs))
    sizes = {i: r["size"] for i, r in got.items()}
    assert sizes[4] == 0 and sizes[1] == 240
    targets = {(r["source_size"], r["target"]) for r in got.values()}
    assert all(t <= 3 * s + 1e-9 for s, t in targets) and all(r["taken"] <= 3 * r["size"] for r in got.values())
    assert sum(r["taken"] for r in got.values()) <= sum(sizes.values())
    assert by_id(mixing.mix(docs)) == got
    times = {}
    for r in mixing.mixed_rows(docs).collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {i: r["copies"] for i, r in got.items() if r["copies"]}


def test_html():
    page = "<html><head><title>x</title></head><body><nav><a>Menu, one.</a></nav><div class='cookie-notice'>We use cookies.</div><article><h1>T &amp; u</h1><p>First   text,<br>on and <b>on</b>.<p>x</article><div class=comments><p>Nice, thanks.</p></div><footer>&copy; all</footer></body></html>"
    assert html.main_text(page) == "T & u\nFirst text, on and on.\nx"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
    assert html.main_text("<div id=c><p>Some text, here.</p><p>More.</p>") == "Some text, here.\nMore."


def test_html_of_whole_pages(spark):
    """The article of every page of the table, read by another parser: its blocks' texts, but for what is never of an article."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        blocks = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "article", "main", "div", "section", "table", "tr", "td", "th", "pre", "br", "figure", "figcaption", "header", "hr"}

        def __init__(self):
            super().__init__()
            self.inside, self.parts, self.skip = 0, [], 0

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside += 1
            if self.inside and tag in self.blocks:
                self.parts.append("\n" if tag != "br" else " ")

        def handle_endtag(self, tag):
            if self.inside and tag in self.blocks:
                self.parts.append("\n")
            if tag == "article":
                self.inside -= 1

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data.replace("\n", " "))

    got = html.extracted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    same = 0
    for r in got:
        a = Article()
        a.feed(pages[r["page_id"]])
        want = [" ".join(x.split()) for x in "".join(a.parts).split("\n")]
        same += r["text"].split("\n") == [x for x in want if x]
    assert len(got) == len(pages) and same >= 0.98 * len(got)


def test_html_split_article():
    long = lambda x, n: f"<p>{' '.join([f'{x} sentence, with words.'] * n)}</p>"
    text = html.main_text(f"<body><div class=story><div>{long('First', 85)}</div><div>{long('Second', 15)}</div></div>")
    assert "First" in text and "Second" in text
    text = html.main_text(f"<main><article>{long('Inner', 10) * 9}</article>{long('Beside', 10) * 2}</main>")
    assert "Inner" in text and "Beside" in text


@pytest.mark.parametrize("page", ["<head><title>t</title><body><p>Some text.</p>", "<html><head><title>t</title><p>Some text.</p>", "<head><title>t</title>Some text.", *(f"<div><{t}>x</div><p>Some text.</p>" for t in ("button", "select", "svg")), *(f"<{t}><p>Some text.</p>" for t in ("button", "select", "svg", "noscript", "template"))])
def test_html_unclosed(page):
    assert html.main_text(page).splitlines()[-1] == "Some text."


@pytest.mark.parametrize("attributes", ["class='content no-sidebar'", "class=has-sidebar", "class='with-comments'", "data-id=sidebar", "class='x hidden md:block'", "title='the hidden truth'", "class=sidebar", "id=comments"])
def test_html_names(attributes):
    body = "<h1 class='section-header'>Title</h1><p>Some text, and more.</p>"
    assert html.main_text(f"<body><div {attributes}><article>{body}</article></div><div class='sidebar'><p>Side, one.</p></div>") == "Title\nSome text, and more."
    assert "Side" not in html.main_text(f"<article>{body}</article><div class='sidebar left'><p>Side, one.</p></div><div id=site-footer>Foot.</div>")


def test_html_query(spark):
    d = spark.createDataFrame([(1, "u", "<article><p>Hi.</p></article>"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extracted(d).collect()) == [(1, "Hi.", 3), (2, "", 0)]


def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    model = langid.learn(d.select("doc_id", "text", "lang"))
    a, b = (d.where(f"lang = '{x}'").select("text").first()[0][:2000] for x in ("en", "de"))
    assert [s[2] for s in langid.spans(model, a + " " + b)] == ["en", "de"]
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 34", None), (3, a, "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identified(odd, model).collect()} == {1: "und", 2: "und", 3: "en"}


def test_viterbi_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(30):
        s = rng.normal(size=(6, 3))
        paths = {p: sum(s[t, p[t]] for t in range(6)) - 1.5 * sum(a != b for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=6)}
        assert tuple(langid.viterbi([s], 1.5)[0]) == max(paths, key=paths.get)


def test_toxicity(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = d.where("crc32(cast(doc_id as string)) % 4 = 2")
    y = labels.selectExpr("doc_id", "1 - quality AS low_quality", "toxic")
    chain = toxicity.learn(d, y.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    got = toxicity.scored(held, chain).join(labels.selectExpr("doc_id", "toxic AS label"), "doc_id").collect()
    caught = [r["toxic"] for r in got if r["label"] == 1]
    clean = [r["toxic"] for r in got if r["label"] == 0]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.02 * len(clean)
    none = toxicity.toxicity(d.limit(3), labels.limit(0)).collect()
    assert len(none) == 3 and not any(r["toxic"] for r in none)


@pytest.mark.parametrize("share, quality", [(0.5, 1), (0.85, 1), (0.15, None)])
def test_toxicity_label_shares(spark, share, quality):
    """Balanced and toxic-heavy labels, and toxic rows whose quality isn't known; plain words only."""
    rng, data = random.Random(7), []
    for i in range(900):
        bad = rng.random() < share
        words = [f"plain{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(8))}" for _ in range(30)] + [rng.choice("grumpf blargh snarfle wozzick drubbin".split()) for _ in range(2 * bad)]
        rng.shuffle(words)
        data.append((i, " ".join(words), quality if bad else i % 2, int(bad)))
    d = spark.createDataFrame(data, "doc_id long, text string, quality int, toxic int").repartition(2)
    y = d.where("doc_id < 600").selectExpr("doc_id", "1 - quality AS low_quality", "toxic")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.scored(d.where("doc_id >= 600"), toxicity.learn(d, y)).collect()}
    caught, clean = ([got[i] for i, _, _, bad in data if i >= 600 and bad == k] for k in (1, 0))
    assert sum(caught) >= 0.95 * len(caught) and sum(clean) <= 0.05 * len(clean)


def test_close_keeps_similar_pairs(spark):
    rng = np.random.default_rng(5)
    have, pairs, similar = [(0, np.zeros(0, np.uint64)), (1, np.unique(rng.integers(0, 1 << 63, 1).astype(np.uint64)))], [(1, 0)], set()
    for k in range(200):
        x = rng.integers(0, 1 << 63, int(rng.integers(1, 300))).astype(np.uint64)
        y = np.concatenate([x[int(len(x) * rng.random() * 0.4) :], rng.integers(0, 1 << 63, int(len(x) * rng.random() * 0.3)).astype(np.uint64)])
        x, y, a, b = np.unique(x), np.unique(y), 2 * k + 3, 2 * k + 2
        have += [(a, x), (b, y)]
        pairs.append((a, b))
        if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
            similar.add((a, b))
    bits = spark.createDataFrame([(i, len(h), simhash._bits(h).tolist()) for i, h in have], "id long, n long, bits array<long>")
    got = {(r["a"], r["b"]) for r in simhash._close(spark.createDataFrame(pairs, "a long, b long"), bits, 0.8).collect()}
    assert similar <= got and 20 < len(similar) and len(got) < len(similar) + 40
