"""Operator 4, quality rules: a short-circuit cascade, in DataFrame functions only.

Each rule has a rejecting condition and a cost, in characters that it looks at and how often. On a sample of the rows the rules' rejections and
costs are estimated, and the rules are put in order of rejections per cost, each among the rows that the earlier ones leave.
The cascade is one CASE WHEN: a row that an early rule rejects is not looked at by the later ones. The order changes what is
computed, never the verdict.

Null text has no words, so the base rule rejects it. Empty tables give empty results; with no sample the declared order holds.
Repeated rows, and rows with a null doc_id, are judged alike. All columns of the input may stay (see kept()), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BLANKS, GAP

SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS, SAMPLE_SHARE = 500, 0.02
MARK = "__quill_"  # prefix of working columns


@dataclass(frozen=True)
class Rule:
    """reject: true where the row goes; cost: characters looked at, beside one for the look itself."""

    name: str
    reject: Column
    cost: Column


def _c(name: str) -> Column:
    return F.col(MARK + name)


def _bind(c: Column, f) -> Column:
    """f of a column that is evaluated once, however often f uses it, and only where the whole is."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more: the windows in order of their hashes (words decide where hashes agree), only where
    a hash occurs twice; then the places of those with an equal neighbour, each covering up to three words."""
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    window = lambda h, i: F.struct(h.alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    places = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"]))
    covered = lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), i + 3) - i)), F.lit(0), lambda n, x: n + x)
    found = lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), _bind(F.sort_array(F.transform(t, window)), lambda s: _bind(places(s), covered)))
    return F.coalesce(_bind(hashes, found), F.lit(0)).cast("long")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the cheap measures as working columns."""
    d = docs.withColumn(MARK + "text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    words = F.split(F.btrim(_c("text"), F.lit(BLANKS)), GAP)
    d = d.withColumn(MARK + "w", F.when(F.btrim(_c("text"), F.lit(BLANKS)) == "", F.array().cast("array<string>")).otherwise(words))
    d = d.withColumns({MARK + "n_words": F.size(_c("w")).cast("long"), MARK + "word_chars": F.length(F.array_join(_c("w"), "")).cast("long"), MARK + "lines": F.filter(F.split(_c("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # a filter on a verdict must not be pushed below this projection: it would take copies of all of these expressions along
    return d.withColumns({
        MARK + "bar": F.rand(0),
        MARK + "n_symbols": F.regexp_count(_c("text"), F.lit(SYMBOLS)).cast("long"),
        MARK + "n_lines": F.size(_c("lines")).cast("long"),
        MARK + "n_dup_lines": (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long"),
    })


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add all base measures as working columns."""
    return with_measures(docs, text).withColumn(MARK + "n_repeat_words", repeat_words(_c("w")))


def base_failed() -> Column:
    return (_c("n_words") < 50) | (100 * _c("n_repeat_words") > 50 * _c("n_words"))


def verdict(measured: DataFrame) -> Column:
    """'base', the name of the first rule that rejects the row, or null."""
    return F.when(_c("bar") < 0, F.lit("")).when(base_failed(), F.lit("base")).otherwise(cascade(measured))


def base_rules() -> list[Rule]:
    """The base rule in two, for a cascade that needn't tell it from the others. Looking for repeats costs most by far: some forty counts."""
    return [Rule("few_words", _c("n_words") < 50, F.lit(0.0)), Rule("repeats", 100 * repeat_words(_c("w")) > 50 * _c("n_words"), 40 * F.length(_c("text")).cast("double"))]


def default_rules() -> list[Rule]:
    """Thresholds in whole numbers: symbols at one to ten words, lines repeated, shouting, words of odd length, few letters."""
    text, n = _c("text"), _c("n_words")
    length = F.length(text).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return [
        Rule("symbols", 10 * _c("n_symbols") > n, F.lit(0.0)),
        Rule("repeated_lines", 10 * _c("n_dup_lines") > 3 * _c("n_lines"), F.lit(0.0)),
        Rule("word_length", (_c("word_chars") < 2 * n) | (_c("word_chars") > 20 * n), F.lit(0.0)),
        Rule("exclamations", 10 * count("!") > 3 * n, length),
        Rule("capitals", 2 * count(r"\p{Lu}") > count(r"\p{L}"), 2 * length),
        Rule("letters", 2 * count(r"\p{L}") < _c("word_chars"), 1.5 * length),
    ]


def order(rules: list[Rule], seen: list[list]) -> list[int]:
    """Indices of rules by rejection per cost; seen has, for each sampled row, each rule's verdict and then each rule's cost."""
    left, out, n = list(range(len(rules))), [], len(rules)
    while left:
        worth = [(-sum(r[k] for r in seen) / (sum(1 + r[n + k] for r in seen) or 1), k) for k in left]
        best = min(worth)[1]
        out.append(best)
        left.remove(best)
        seen = [r for r in seen if not r[best]]
    return out


def cascade(measured: DataFrame, rules: list[Rule] | None = None) -> Column:
    """The name of the first rule that rejects the row, or null. Takes what with_base() returns; runs one small job."""
    rules = rules or default_rules()
    cols = [F.coalesce(r.reject, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)] + [F.coalesce(r.cost, F.lit(0.0)).alias(f"c{i}") for i, r in enumerate(rules)]
    seen = [list(r) for r in measured.sample(SAMPLE_SHARE, seed=11).select(*cols).limit(SAMPLE_ROWS).collect()]
    verdict = None
    for k in order(rules, seen):
        verdict = (F if verdict is None else verdict).when(rules[k].reject, F.lit(rules[k].name))
    return verdict


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and the rule that rejected the row ('base', a rule's name, or null)."""
    d = with_base(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return d.select("doc_id", *[_c(n).alias(n) for n in names], base_failed().alias("base_failed"), verdict(d).alias("rule")).withColumn("kept", F.col("rule").isNull())


def kept(docs: DataFrame) -> DataFrame:
    """The rows that pass, with exactly the input's columns. The base rule is in the cascade too: rows that a cheaper rule rejects aren't
    searched for repeats."""
    d = with_measures(docs)
    verdict = F.when(_c("bar") < 0, F.lit("")).otherwise(cascade(d, base_rules() + default_rules()))
    return d.where(verdict.isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same in DuckDB, for the query's columns without the rule's name.
_MEASURES = r"""
t AS (SELECT {keys}, coalesce(text, '') AS x FROM {source}),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id AS g_id, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM w)),
d AS (SELECT g_id, k FROM (SELECT g_id, k, count(*) OVER (PARTITION BY g_id, tri) AS c FROM g) WHERE c > 1),
r AS (SELECT g_id, count(DISTINCT k + o) AS n FROM d, (SELECT unnest([0, 1, 2]) AS o) GROUP BY g_id),
m AS (SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, length(x) - length(regexp_replace(x, '!', '', 'g')) AS n_bang,
  length(x) - length(regexp_replace(x, '\p{Lu}', '', 'g')) AS n_upper, length(x) - length(regexp_replace(x, '\p{L}', '', 'g')) AS n_letters FROM w LEFT JOIN r ON r.g_id = w.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
  OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_bang > 3 * n_words OR 2 * n_upper > n_letters OR 2 * n_letters < word_chars) AS kept FROM m)
"""
ORACLE_SQL = "WITH " + _MEASURES.replace("{keys}", "doc_id").replace("{source}", "documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM v"
