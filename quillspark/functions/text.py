"""Text correction as columns: each stage takes a column and returns one; fix_text is all of them in order. Null stays null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import correct
from quillspark.functions import rules as R
from quillspark.functions.correct import MODES, RUN

# White space as Python's str has it, in Java's syntax and as characters.
SPACE_IN = r"\s\x1c-\x1f"
SPACE = f"[{SPACE_IN}]"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def each(c: Column, f) -> Column:
    """f of every string of a column, over Arrow batches."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run(c)


def apply_rules(c: Column, rules) -> Column:
    """Rules one after the other."""
    return each(c, lambda t: correct.apply_rules(t, rules))


def normalize_unicode(c: Column) -> Column:
    """NFC, which Spark has no function for; plain ASCII stays in the engine."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(each(c, correct.normalize_unicode))


def replace_chars(c: Column) -> Column:
    for a, b in R.CHARS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clean_brackets(c: Column) -> Column:
    return each(c, correct.clean_brackets)


def latin_in_greek(c: Column) -> Column:
    return each(c, correct.latin_in_greek)


def general_rules(c: Column) -> Column:
    return each(c, correct.general_rules)


def corpus_rules(c: Column) -> Column:
    return each(c, correct.corpus_rules)


def epigraphic(c: Column) -> Column:
    return each(c, correct.epigraphic)


def word_rules(c: Column) -> Column:
    return each(c, correct.word_rules)


def segments(c: Column) -> Column:
    """The text as an array of Greek runs and what lies between them."""
    return F.regexp_extract_all(c, F.lit(f"{RUN}|[^Ͱ-Ͽἀ-῿]+"), F.lit(0))


def segment_rules(c: Column, greek: bool = True) -> Column:
    return each(c, lambda t: correct.segment_rules(t, greek))


def greek_block(c: Column) -> Column:
    return each(c, correct.greek_block)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def fix_text(c: Column, mode: str = "full", include_corpus_specific: bool = True) -> Column:
    """The whole correction, in one pass."""
    if mode not in MODES:
        raise ValueError(f"invalid mode: {mode!r}; it is one of {', '.join(MODES)}")
    return each(c, lambda t: correct.fix_text(t, mode, include_corpus_specific))


def fix_cell(c: Column) -> Column:
    """A table cell: empty for null, a number as it is, else corrected."""
    return F.when(c.isNull() | (c == ""), "").when(numeric_cell(c), strip(c)).otherwise(fix_text(c))


def fix_grid(grid: Column) -> Column:
    """fix_cell of every cell of rows of cells; null where the grid is."""

    @F.pandas_udf("array<array<string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda rows: [[correct.fix_cell(c) for c in r] if r is not None else [] for r in rows], na_action="ignore")

    return run(grid)


def numeric_cell(c: Column) -> Column:
    return c.rlike(rf"(?U)^{SPACE}*\p{{Nd}}+(?:[.,]\p{{Nd}}+)?{SPACE}*$")


def private_use(c: Column) -> Column:
    for a, b in R.PRIVATE_USE:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def join_greek_fragments(c: Column) -> Column:
    return each(c, correct.join_greek_fragments)


# The words that begin a caption of a table, and of a figure.
TABLE_WORDS = r"Table|Tab\.?|Tabla|Cuadro|Tableau"
FIGURE_WORDS = r"Figure|Fig\.?|Abbildung|Abb\.?|Tav\.?"


def _caption(words: str) -> str:
    return rf"(?imdU)^{SPACE}*(?:{words}){SPACE}*\.?{SPACE}*\p{{Nd}}+"


CAPTION = _caption(TABLE_WORDS)


def is_table_caption(c: Column) -> Column:
    return c.rlike(CAPTION)


def is_figure_caption(c: Column) -> Column:
    return c.rlike(_caption(FIGURE_WORDS))


def language_codes(c: Column) -> Column:
    """The codes of a list such as eng+grc."""
    return F.split(c, r"\+")


def language_list(selected: Column, order) -> Column:
    """The selected codes in the given order, as such a list; null where none is selected."""
    found = F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(selected, x))
    return F.when(F.size(found) > 0, F.array_join(found, "+"))


def missing_languages(needed: Column, installed: Column) -> Column:
    return F.array_except(needed, installed)


def parse_issue(body: Column) -> Column:
    """A form's sections as a map from lower-cased heading to trimmed value; of two with one heading the last holds."""
    blocks = F.transform(F.split(strip(body), "\n### "), lambda b: strip(F.regexp_replace(b, r"\A[# ]+", "")))
    entry = lambda b: F.struct(F.lower(strip(F.substring_index(b, "\n", 1))).alias("key"), strip(F.substring(b, F.locate("\n", b) + 1, F.length(b))).alias("value"))
    entries = F.transform(F.filter(blocks, lambda b: b.contains("\n")), entry)
    last = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


# The headings of an issue form, what an empty answer says, and how the answer for all documents begins.
BAD, GOOD, CONTEXT, SCOPE = "texto que salió mal", "texto correcto", "frase completa (contexto)", "¿este error se repite en cualquier documento o es propio de este pdf concreto?"
NO_ANSWER, ALL_DOCUMENTS = "_No response_", "Cualquier documento"


def issue_rule(number: Column, body: Column) -> Column:
    """route (general, corpus or incomplete), pattern, replacement and description of the rule that an issue asks for."""
    fields = parse_issue(F.coalesce(body, F.lit("")))
    get = lambda k: F.coalesce(F.element_at(fields, F.lit(k)), F.lit(""))
    bad, good, context = get(BAD), get(GOOD), get(CONTEXT)
    route = F.when((bad == "") | (good == ""), "incomplete").when(get(SCOPE).startswith(ALL_DOCUMENTS), "general").otherwise("corpus")
    whole = route != "incomplete"
    said = F.concat(F.lit("issue #"), number.cast("string"), F.when((context != "") & (context != NO_ANSWER), F.concat(F.lit(": "), F.substring(context, 1, 60))).otherwise(""))
    escaped = F.regexp_replace(bad, r"[()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0b\f]", r"\\$0")
    return F.struct(route.alias("route"), F.when(whole, escaped).alias("pattern"), F.when(whole, good).alias("replacement"), F.when(whole, strip(F.replace(said, F.lit("\n"), F.lit(" ")))).alias("description"))
