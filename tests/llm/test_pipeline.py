"""The pipeline against a brute-force version, on the smallest tables."""

import hashlib
import itertools

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import langid, mixing, quality


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())

    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality.quality(docs).collect() if r["kept"]}
    passed = docs.where(docs.doc_id.isin(list(good)))
    known = {r["doc_id"] for r in langid.identified(passed, langid.learn(passed.where("crc32(cast(doc_id as string)) % 4 <> 2").select("doc_id", "text", "lang"))).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, parent = {i: shingles(rows[i]["text"] or "") for i in known}, {i: i for i in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(known), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    unique = {find(i) for i in known}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.where(docs.doc_id.isin(list(unique)))).collect()}

    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i in unique:
        ids = library.encode(rows[i]["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * copies[i]
    assert got == sorted(want) and 0 < len(unique) < len(known) < len(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "mixing", "bpe"]
