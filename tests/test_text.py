import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import rules as R
from quillspark.functions import text as T


def apply(spark, f, *values):
    rows = [(i, v) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(got)]


def plain(text, mode="full", corpus=True):
    """The same corrections restated with Python's re."""
    text = unicodedata.normalize("NFC", text)
    for a, b in R.CHARS:
        text = text.replace(a, b)
    for a, b in R.OPENING_CLOSING:
        text = re.sub(r"\s+" + re.escape(b), lambda m, b=b: b, re.sub(re.escape(a) + r"\s+", lambda m, a=a: a, text))
    table = dict(R.IN_GREEK)
    text = re.sub(f"(?<={R.GREEK})([a-z])(?={R.GREEK})", lambda m: table.get(m[1], m[1]), text)

    def run(text, some):
        for _, p, f, r in some:
            text = re.sub(p, r, text, flags=(re.I if "i" in f else 0) | (re.M if "m" in f else 0))
        return text

    text = run(text, R.GENERAL + (R.CORPUS if corpus else []))
    text = re.sub("<([^>]+)>", lambda m: "<" + m[1].translate(str.maketrans(*R.EPIGRAPHIC)) + ">", text)
    out = []
    for part in re.findall(rf"{T.RUN}|[^Ͱ-Ͽἀ-῿]+", text):
        if re.match(R.GREEK, part):
            part = run(part, R.GREEK_RUN_RULES[:2]) if mode != "general" else part
        else:
            for a, b in R.WORDS:
                part = re.sub(rf"\b{a}\b" + (r"(?!\.)" if b == a + "." else ""), b, part)
        out.append(part)
    return "".join(out).strip()


CASES = [
    ("exam-\nple", "example"), ("hola , mundo !", "hola, mundo!"), ("text\n---\nmore", "text\n\nmore"), ("wor1d", "world"), ("1nformation", "1nformation"),
    ("λόγijος", "λόγηος"), ("λό(ργος", "λόφγος"), ("[ ἀγαθ οῦ ]", "[ἀγαθ οῦ]"), ("1234", ""), ("a\tb", "a b"), ("afios", "años"), ("ibid", "ibid."), ("ibid.", "ibid."), ("λόγοσ", "λόγος"), ("<AB>", "<ΑΒ>"),
]


def test_examples(spark):
    assert apply(spark, T.fix_text, *[a for a, _ in CASES]) == [b for _, b in CASES]


def test_null_empty_and_modes(spark):
    assert apply(spark, T.fix_text, None, "") == [None, ""]
    assert apply(spark, lambda c: T.fix_text(c, "general"), "λόγοσ") == ["λόγοσ"]
    assert apply(spark, lambda c: T.fix_text(c, include_corpus_specific=False), "acentuaci6n") == ["acentuaci6n"]
    with pytest.raises(ValueError):
        T.fix_text(F.lit("x"), "other")


def test_cells(spark):
    assert apply(spark, T.fix_cell, "30", None, " 1,5 ", "a  b") == ["30", "", "1,5", "a b"]
    assert apply(spark, T.is_table_caption, "Table 1", "x\n Tabla 3", "Figure 1", "Tab. 4", "Tablero") == [True, True, False, True, False]


def test_join_fragments(spark):
    assert apply(spark, T.join_greek_fragments, "λό γος", "καὶ λό", "ἀγαθός λόγος", None) == ["λόγος", "καὶ λό", "ἀγαθός λόγος", None]


bits = st.lists(st.sampled_from(["λό", "γος", "σ", "ἀ", "a", "v", "ij", "cp", "(ρ", "[", "]", "<AB>", "<", ">", " ", "  ", "\n", "-\n", "12", "1", "0", "el", ".", " ,", "'", ";", "é", "́", "\xa0", "afios", "ibid", "---", "$ 4", "«", "»", "\t", "p p. 3", "relaci6n", "BRΟAD", "siécle", "prés de", "Dodone,x", "ﬁ"]), max_size=14).map("".join)


@settings(max_examples=3, deadline=None)
@given(st.lists(bits, min_size=120, max_size=120))
def test_agrees_with_plain_python(spark, texts):
    assert apply(spark, T.fix_text, *texts) == [plain(t) for t in texts]
    assert apply(spark, lambda c: T.fix_text(c, "general", False), *texts) == [plain(t, "general", False) for t in texts]
