"""The library's queries over the driver's tables, and the same in SQL.

The tables hold few of the errors that the rules correct, so each query first puts some in, by an expression that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import quality, rules, text
from quillspark.operators import images, pages, tables
from quillspark.plans import oracles

QUERIES: dict = {}
ORACLES: dict = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(d: DataFrame) -> DataFrame:
    """A table of fewer partitions than the cores could share, dealt out over them; larger ones stay as they are."""
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(2 * cores) if d.rdd.getNumPartitions() < 2 * cores else d


def _column(name: str, noise, change, sql: str | None) -> None:
    """A query that puts noise into documents, changes the text, and returns it with its length before. noise: SQL of both engines, or a function that gives a column, and SQL."""
    column, noise_sql = (lambda: F.expr(noise), noise) if isinstance(noise, str) else noise

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _spread(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", column().alias("t"))
        return d.select("doc_id", F.length("t").cast("long").alias("n_before"), change(F.col("t")).alias("text"))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = f"WITH n AS (SELECT doc_id, {noise_sql} AS t FROM documents) SELECT doc_id, CAST(length(t) AS BIGINT) AS n_before, {sql} AS text FROM n"


def _errors(texts: list[str]):
    """One of the texts, by doc_id, before each document."""
    k = f"CAST(doc_id % {len(texts)} AS INT) + 1"
    return lambda: F.concat(F.element_at(F.array(*map(F.lit, texts)), F.expr(k)), F.lit(" "), F.col("text")), f"{oracles.listed(texts)}[{k}] || ' ' || text"


def _rules(*ids):
    return [r for r in rules.GENERAL + rules.CORPUS if r[0] in ids]


def _general(name: str, noise: str, *ids: str) -> None:
    _column(name, noise, lambda c: text.apply_rules(c, _rules(*ids)), oracles.general("t", *ids))


_column("char_replacements", "replace(replace(text, 'fi', '\ufb01'), ' th', '\u00a0th') || chr(12) || chr(13) || chr(10) || chr(13) || '\ufb00\ufb02\ufb03\ufb04\ufb06\u200b\u200c\ufeff'", text.replace_chars, oracles.chars("t"))
_column("nfc_normalize", "replace(replace(text, 'é', 'e\u0301'), 'ü', 'u\u0308')", text.normalize_unicode, "nfc_normalize(t)")
_column("bracket_cleanup", "'[ ἀγαθ[ο]ῦ ] ( x) {y } ⟨ z ⟩ ' || replace(text, ' the ', ' ( the ) ')", text.clean_brackets, oracles.regex("t", *oracles.BRACKETS))
_column("latin_in_greek", "'λόaγος λοrγvος xαx αbαeαiαkαnαoαpαtαuαwαxαzα ' || text", text.latin_in_greek, oracles.latin("t"))
_general("page_number_removal", "text || chr(10) || CAST(doc_id % 1000 AS STRING) || chr(10) || 'end'", "G01")
_general("separator_removal", "text || chr(10) || '-----' || chr(10) || 'end'", "G20")
_general("dehyphenate", "replace(replace(text, 'ti', 't-' || chr(10) || 'i'), 'on', 'o- ' || chr(10) || 'n')", "G02", "G03")
_general("whitespace_cleanup", "replace(replace(replace(text, ' ', '  '), '. ', chr(9) || chr(9)), ',', chr(10) || chr(10) || chr(10))", "G04", "G06", "G19")
_general("space_before_punctuation", "replace(replace(text, ', ', ' , '), '. ', ' . ' || chr(10))", "G05")
_general("digit_letter_confusion", "replace(replace(text, 'el', 'e1'), 'no', 'n0')", "G07", "G08")
_general("greek_multichar", "'λόγijος rjλ λcpα ij <pω λ©μ ' || text", "G09", "G10", "G11", "G12", "G13")
_general("greek_interior_marks", "'λό;γος λό\u0313γος λ\u0314ο; ' || text", "G14", "G15")
_general("bibliographic", "'p p. 12 I bid op . cit . $$ 12 $ 4 «  a  » /9:/ [9:] /\"a ' || text", "G16", "G17", "G18", "G21", "G22", "G23", "G24", "G25", "G26", "G27")
_column("general_rules", _errors(oracles.GENERAL_ERRORS), text.general_rules, oracles.general("t"))
_column("corpus_rules", _errors([e for e, _, _ in oracles.CORPUS]), text.corpus_rules, oracles.corpus("t"))
_column("epigraphic", f"'<{''.join(oracles.CAPITALS)}> <ABC J> <d E> < ' || text", text.epigraphic, oracles.angles("t"))
_column("private_use", "'\ue1b0x\ue1c3' || text", text.private_use, oracles.replaced("t", ("\ue1b0", "ε\u0342"), ("\ue1c3", "ο\u0342")))
_column("final_sigma", "'πόσ[ισ]ιν λόγοσ, σοφόσ λό(ργος (ρ ' || text", text.segment_rules, oracles.segments("t"))
_column("word_replacements", _errors([f"{a} x{a} {a}." for a, _ in oracles.WORDS]), text.word_rules, oracles.words("t"))
_column("strip_diacritics", "text", quality.strip_diacritics, "strip_accents(t)")
_NOISE = "'[ ἀγαθ[ο]ῦ ] <AB> λόγijος acentuaci6n wor1d lhéte ' || replace(replace(text, '. ', ' . '), 'fi', '\ufb01') || chr(10) || CAST(doc_id % 1000 AS STRING) || chr(10) || 'end'"


def _fixed(name: str, noise, mode: str, with_corpus: bool) -> None:
    column, sql = (lambda: F.expr(noise), noise) if isinstance(noise, str) else noise
    _column(name, (column, sql), lambda c: text.fix_text(c, mode, with_corpus), None)
    ORACLES[name] = f"WITH {oracles.fixed(f'SELECT doc_id, {sql} AS t FROM documents', 'doc_id', mode, with_corpus)} SELECT doc_id, CAST(length(f0.t) AS BIGINT) AS n_before, f.t AS text FROM f0 JOIN f USING (doc_id)"


_fixed("fix_text_full", _NOISE, "full", True)
_fixed("fix_text_errors", _errors(oracles.ERRORS), "full", True)
_fixed("fix_text_greek", _errors(oracles.ERRORS), "greek", True)
_fixed("fix_text_general", _errors(oracles.ERRORS), "general", True)
_fixed("fix_text_no_corpus", _errors(oracles.ERRORS), "full", False)
# What the fragments become is stated, not computed: a particle stays alone, a short fragment doesn't, nor do two long ones meet.
_column("join_greek_fragments", "'λό γος καὶ ἀγαθ οῦ , ἀγαθός λόγος ' || text", text.join_greek_fragments, "replace(t, 'λό γος καὶ ἀγαθ οῦ , ', 'λόγος καὶ ἀγαθοῦ , ')")
_column("greek_block", "'λcpόγος <pωτός (ρό νον λόγοσ ' || text", text.greek_block, "replace(replace(replace(t, 'λcpόγος <pωτός (ρό νον λόγοσ ', 'λφόγος φωτός φόνον λόγος '), 'cp', 'φ'), '<p', 'φ')")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CLEAN = "replace(CASE WHEN doc_id % 3 = 0 THEN replace(replace(text, '. ', ' . '), ' ', '  ') ELSE text END, 'fi', '\ufb01')"
_STRIPPED = oracles.strip(oracles.general(oracles.chars("t"), "G04", "G05", "G06"))


@_query(f"WITH n AS (SELECT lang, {_CLEAN} AS t FROM documents), c AS (SELECT lang, length(t) AS a, length({_STRIPPED}) AS b FROM n) SELECT lang, count(*) AS n_docs, CAST(sum(a - b) AS BIGINT) AS chars_removed, count(*) FILTER (WHERE a <> b) AS n_changed FROM c GROUP BY lang")
def cleanup_by_language(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("lang", F.expr(_CLEAN).alias("t"))
    d = d.select("lang", F.length("t").alias("a"), F.length(text.strip(text.apply_rules(text.replace_chars(F.col("t")), _rules("G04", "G05", "G06")))).alias("b"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.col("a") - F.col("b")).cast("long").alias("chars_removed"), F.count_if(F.col("a") != F.col("b")).alias("n_changed"))


@_query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN regexp_matches(' ' || CAST(p_size AS VARCHAR) || ' ', '^\\s*[0-9]+([.,][0-9]+)?\\s*$') ELSE regexp_matches(p_name, '^\\s*[0-9]+([.,][0-9]+)?\\s*$') END AS is_number FROM part")
def numeric_cells(spark, sf_dir):
    cell = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).otherwise(F.col("p_name"))
    return _read(spark, sf_dir, "part").select("p_partkey", text.numeric_cell(cell).alias("is_number"))


@_query(f"WITH {oracles.fixed("SELECT p_partkey, p_name || ' acentuaci6n . ' AS t FROM part", 'p_partkey')} SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '30' ELSE t END AS cell FROM f")
def fix_cell(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", text.fix_cell(F.when(F.col("p_partkey") % 5 == 0, F.lit(" 30 ")).otherwise(F.concat(F.col("p_name"), F.lit(" acentuaci6n . ")))).alias("cell"))


@_query("SELECT doc_id, unnest(regexp_extract_all('λόγος [ἀγαθ[ο]ῦ] ' || text, '[Ͱ-Ͽἀ-῿]+(?:[\\[\\](){}⟨⟩][Ͱ-Ͽἀ-῿]+)*|[^Ͱ-Ͽἀ-῿]+')) AS segment FROM documents")
def greek_segments(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.explode(text.segments(F.concat(F.lit("λόγος [ἀγαθ[ο]ῦ] "), "text"))).alias("segment"))


_FORM = "'### Texto que salió mal' || chr(10) || chr(10) || ' bad.' || CAST(doc_id AS STRING) || ' (x) ' || chr(10) || '### Texto correcto' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'good' END || chr(10) || '### Frase completa (contexto)' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '_No response_' ELSE 'line one' || chr(10) || 'two' END || chr(10) || '### ¿Este error se repite en cualquier documento o es propio de este PDF concreto?' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Cualquier documento (general)' ELSE 'Solo este' END || chr(10) || '### Empty'"


@_query("SELECT doc_id, 'bad.' || CAST(doc_id AS VARCHAR) || ' (x)' AS bad, CASE WHEN doc_id % 5 > 0 THEN 'good' END AS good, CASE WHEN doc_id % 5 > 0 THEN 4 ELSE 3 END AS n FROM documents")
def issue_form(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", text.parse_issue(F.expr(_FORM)).alias("m"))
    return d.select("doc_id", F.element_at("m", text.BAD).alias("bad"), F.element_at("m", text.GOOD).alias("good"), F.size("m").alias("n"))


@_query(r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'incomplete' WHEN doc_id % 2 = 0 THEN 'general' ELSE 'corpus' END AS route, CASE WHEN doc_id % 5 <> 0 THEN 'bad\.' || doc_id || '\ \(x\)' END AS pattern,
CASE WHEN doc_id % 5 <> 0 THEN 'good' END AS replacement, CASE WHEN doc_id % 5 <> 0 THEN 'issue #' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ': line one two' END END AS description FROM documents""")
def issue_rules(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.issue_rule(F.col("doc_id"), F.expr(_FORM)).alias("r")).select("doc_id", "r.*")


@_query("SELECT stage, CAST(place AS INTEGER) AS place, id FROM (SELECT 'general' AS stage, i AS place, 'G' || lpad(CAST(i AS VARCHAR), 2, '0') AS id FROM range(1, 28) t(i) UNION ALL SELECT 'corpus', 27 + i, 'C' || lpad(CAST(i AS VARCHAR), 2, '0') FROM range(1, 76) t(i))")
def rule_table(spark, sf_dir):
    """General and corpus rules, one after the other, without the patterns that both have (there are none)."""
    table = lambda stage, some, first: spark.createDataFrame([(stage, first + k, r[0], r[1]) for k, r in enumerate(some)], "stage string, place int, id string, pattern string")
    general, corpus = table("general", rules.GENERAL, 1), table("corpus", rules.CORPUS, 1 + len(rules.GENERAL))
    both = general.select("pattern").intersect(corpus.select("pattern"))
    return general.unionByName(corpus).join(F.broadcast(both), "pattern", "left_anti").select("stage", "place", "id")


@_query("SELECT doc_id, array_to_string(string_split(coalesce(lang, 'eng') || '+grc', '+'), ',') AS codes, CASE WHEN lang = 'en' THEN 'grc+en' WHEN lang = 'de' THEN 'grc+de' ELSE 'grc' END AS chosen, CASE WHEN lang IN ('en', 'de') THEN '' ELSE coalesce(lang, 'eng') END AS missing FROM documents")
def language_lists(spark, sf_dir):
    codes = text.language_codes(F.concat(F.coalesce("lang", F.lit("eng")), F.lit("+grc")))
    installed = F.array(F.lit("en"), F.lit("de"), F.lit("grc"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(codes, ",").alias("codes"), text.language_list(codes, ["grc", "en", "de"]).alias("chosen"), F.array_join(text.missing_languages(codes, installed), ",").alias("missing"))


@_query("SELECT doc_id, doc_id % 3 < 2 AS figure, doc_id % 3 = 2 AS is_table FROM documents")
def figure_captions(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.expr("CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'x' || chr(10) || ' Fig. 2 y' WHEN 1 THEN 'ABBILDUNG 3' ELSE 'Tab. 4' END").alias("t"))
    return d.select("doc_id", text.is_figure_caption(F.col("t")).alias("figure"), text.is_table_caption(F.col("t")).alias("is_table"))


def _turns(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Table 1. x\n"), "text")).otherwise(F.col("text")).alias("text"))


_TURNS = "t AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_number, CASE WHEN turn % 3 = 1 THEN 'Table 1. x' || chr(10) || text ELSE text END AS text FROM conversations)"


@_query(f"WITH {_TURNS}, c AS (SELECT *, regexp_matches(text, '(?im)^\\s*(Table|Tab\\.?|Tabla|Cuadro|Tableau)\\s*\\.?\\s*[0-9]+') AS has_caption FROM t) SELECT doc_id, page_number, has_caption, has_caption OR lag(has_caption, 1, false) OVER (PARTITION BY doc_id ORDER BY page_number) AS in_scope FROM c")
def caption_window(spark, sf_dir):
    return tables.caption_window(_turns(spark, sf_dir)).drop("text")


@_query(f"WITH {_TURNS} SELECT doc_id, page_number FROM t WHERE page_number BETWEEN 2 AND 3")
def page_range(spark, sf_dir):
    return pages.page_range(_turns(spark, sf_dir), "2-3").select("doc_id", "page_number")


@_query(f"WITH {_TURNS} SELECT doc_id, string_agg(chr(10) || chr(10) || '--- Page ' || page_number || ' ---' || chr(10) || chr(10) || text, '' ORDER BY page_number, text) AS markdown FROM t GROUP BY doc_id")
def assemble_document(spark, sf_dir):
    return pages.assemble(_turns(spark, sf_dir))


@_query(f"WITH {_TURNS} SELECT doc_id, string_agg(chr(10) || chr(10) || '--- Página ' || page_number || ' ---' || chr(10) || chr(10) || text, '' ORDER BY page_number, text) AS markdown, 'doc' || doc_id || '_pp2-3_tablas.md' AS file FROM t GROUP BY doc_id")
def assemble_spanish(spark, sf_dir):
    return pages.assemble(_turns(spark, sf_dir), "es").withColumn("file", pages.output_name(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), (2, 3), True, "es"))


@_query("SELECT conv_id AS doc_id, turn, CAST(4 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS page_number FROM conversations")
def page_numbers(spark, sf_dir):
    d = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    return pages.numbered(d, "turn", 5).withColumn("page_number", F.col("page_number").cast("int"))


@_query(f"WITH {_TURNS} SELECT doc_id, page_number, CASE WHEN page_number % 3 = 1 AND page_number % 2 = 0 THEN replace(text, 'Table 1. x', 'Table 1. x' || chr(10) || chr(10) || 'T' || page_number || chr(10)) ELSE text END AS text FROM t")
def page_tables(spark, sf_dir):
    p = _turns(spark, sf_dir)
    found = p.where("page_number % 2 = 0").select("doc_id", "page_number", F.explode(F.array(F.lit(2), F.lit(1))).alias("table_ord")).withColumn("markdown", F.when(F.col("table_ord") == 1, F.concat(F.lit("T"), F.col("page_number").cast("string"))).otherwise("surplus"))
    return tables.with_tables(p, found)


_SCOPE = "c AS (SELECT *, regexp_matches(text, '(?im)^\\s*(Table|Tab\\.?|Tabla|Cuadro|Tableau)\\s*\\.?\\s*[0-9]+') AS has FROM t), s AS (SELECT *, has OR lag(has, 1, false) OVER (PARTITION BY doc_id ORDER BY page_number) AS in_scope FROM c)"


@_query(f"WITH {_TURNS}, {_SCOPE} SELECT doc_id, page_number, CAST(1 AS INTEGER) AS table_ord, '| a   | relación |' || chr(10) || '| --- | -------- |' || chr(10) || '| ' || rpad(CAST(page_number AS VARCHAR), 3, ' ') || ' | wo.      |' || chr(10) || '| ccc |          |' AS markdown FROM s WHERE in_scope AND page_number % 5 <> 0")
def digital_tables(spark, sf_dir):
    p = _turns(spark, sf_dir)
    cell = lambda *c: F.array(*[F.lit(x) if x is None or isinstance(x, str) else x for x in c])
    number = F.concat(F.lit(" "), F.col("page_number").cast("string"))
    real = F.array(cell("a", "relaci6n"), cell(number, "wo ."), cell("ccc", None))
    thin = F.array(cell("a", "b"), cell("c", "d"))
    grids = p.select("doc_id", "page_number", F.explode(F.array(F.struct(F.lit(1).alias("table_ord"), thin.alias("grid")), F.struct(F.lit(2).alias("table_ord"), F.when(F.col("page_number") % 5 != 0, real).otherwise(thin).alias("grid")))).alias("x"))
    return tables.extract_tables("digital", p, grids.select("doc_id", "page_number", "x.*"))


@_query(f"WITH {_TURNS}, {_SCOPE}, x AS (SELECT * FROM s WHERE in_scope) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tables, string_agg(CAST(page_number AS VARCHAR) || ':1', ',' ORDER BY page_number) AS pages FROM x GROUP BY doc_id")
def table_totals(spark, sf_dir):
    p = _turns(spark, sf_dir)
    grid = F.array(*[F.array(F.lit("a"), F.lit("b"))] * 3)
    found = tables.extract_digital(p, p.select("doc_id", "page_number", F.lit(1).alias("table_ord"), grid.alias("grid")))
    return tables.table_totals(found).withColumn("pages", F.array_join(F.transform("pages", lambda x: F.concat_ws(":", x["page_number"].cast("string"), x["n"].cast("string"))), ","))


@_query(f"WITH {_TURNS} SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 80 THEN 'digital' ELSE 'scanned' END AS kind FROM t WHERE page_number = 1")
def document_kind(spark, sf_dir):
    return pages.document_kind(_turns(spark, sf_dir))


@_query("SELECT s_suppkey, s_suppkey % 5 >= 2 AND s_suppkey % 3 >= 1 AS valid, CASE WHEN s_suppkey % 5 >= 2 AND s_suppkey % 3 >= 1 THEN s_suppkey % 5 + 1 ELSE 0 END AS n_rows, CASE WHEN s_suppkey % 5 >= 2 AND s_suppkey % 3 >= 1 THEN s_suppkey % 3 + 1 ELSE 0 END AS n_cols FROM supplier")
def scanned_grids(spark, sf_dir):
    """Draws a ruled page for each supplier, cells of 100 x 60 and lines two pixels wide, and finds the cells again."""
    d = _read(spark, sf_dir, "supplier").select("s_suppkey", F.expr("CAST(s_suppkey % 5 + 1 AS INT) AS r"), F.expr("CAST(s_suppkey % 3 + 1 AS INT) AS c"))
    found = images.table_grids(_drawn(d).withColumnRenamed("s_suppkey", "image_id"))
    size = lambda x: F.when(F.col("valid"), F.size(x)).otherwise(0).cast("long")
    return found.select(F.col("image_id").cast("long").alias("s_suppkey"), "valid", size(F.col("grid")).alias("n_rows"), size(F.get("grid", F.lit(0))).alias("n_cols"))


def _drawn(d: DataFrame) -> DataFrame:
    """width, height and pixels of a ruled page with r x c cells."""
    blank, line = "repeat('FF', 100 * c + 82)", "repeat('FF', 40) || repeat('00', 100 * c + 2) || repeat('FF', 40)"
    cell = "repeat('FF', 40) || repeat(repeat('00', 2) || repeat('FF', 98), c) || '0000' || repeat('FF', 40)"
    pixels = f"unhex(repeat({blank}, 40) || repeat(repeat({line}, 2) || repeat({cell}, 58), r) || repeat({line}, 2) || repeat({blank}, 40))"
    return d.selectExpr("*", "100 * c + 82 AS width", "60 * r + 82 AS height", f"{pixels} AS pixels")


@_query("SELECT s_suppkey AS doc_id, CAST(2 AS INTEGER) AS page_number, CAST(1 AS INTEGER) AS table_ord, '| 7' || repeat(' | 7', CAST(s_suppkey % 3 AS INTEGER)) || ' |' || chr(10) || '| -' || repeat(' | -', CAST(s_suppkey % 3 AS INTEGER)) || ' |' || repeat(chr(10) || '| 7' || repeat(' | 7', CAST(s_suppkey % 3 AS INTEGER)) || ' |', CAST(s_suppkey % 5 AS INTEGER)) AS markdown FROM supplier WHERE s_suppkey % 5 >= 2 AND s_suppkey % 3 >= 1 AND s_suppkey % 4 <> 0")
def scanned_tables(spark, sf_dir):
    """A caption on page 1 of three in four documents, and page 2 a drawn page; the recognizer reads the mode that it is asked for."""
    d = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.expr("CAST(s_suppkey % 5 + 1 AS INT) AS r"), F.expr("CAST(s_suppkey % 3 + 1 AS INT) AS c"), F.lit(2).alias("page_number"))
    words = d.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_number")).withColumn("text", F.when((F.col("page_number") == 1) & (F.col("doc_id") % 4 != 0), "Tabla 3").otherwise("x"))
    return tables.extract_tables("scanned", words, images=_drawn(_spread(d)).drop("r", "c"), recognize=lambda pixels, mode: f" {mode}\n")


def _grids(spark, sf_dir):
    row = F.when(F.col("l_linenumber") % 4 == 0, F.array(F.col("l_partkey").cast("string"))).otherwise(F.array(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "l_returnflag")), F.col("l_linenumber").cast("string")))
    d = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", row.alias("r"))
    return d.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "r"))).alias("g")).select("l_orderkey", F.transform("g", lambda s: s["r"]).alias("grid"))


_GRIDS = "c AS (SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_linenumber % 4 = 0 THEN [CAST(l_partkey AS VARCHAR)] ELSE [CAST(l_partkey AS VARCHAR), CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ' ' || l_returnflag END, CAST(l_linenumber AS VARCHAR)] END AS r FROM lineitem), g AS (SELECT l_orderkey, list(r ORDER BY n, r) AS grid FROM c GROUP BY l_orderkey)"


@_query(f"WITH {_GRIDS}, w AS (SELECT l_orderkey, len(r) AS w, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT l_orderkey, max(n) AS n, arg_max(w, n * 100 + w) AS w FROM w GROUP BY l_orderkey), f AS (SELECT l_orderkey, sum(len(list_filter(r, lambda x: trim(x) <> ''))) / sum(len(r)) AS share, count(*) AS n_rows FROM c GROUP BY l_orderkey) SELECT l_orderkey, n_rows >= 3 AND w >= 2 AND n >= 0.75 * n_rows AND share >= 0.5 AS is_table FROM t JOIN f USING (l_orderkey)")
def grid_filter(spark, sf_dir):
    return _grids(spark, sf_dir).select("l_orderkey", tables.is_real_table(F.col("grid")).alias("is_table"))


@_query(f"""WITH {_GRIDS}, x AS (SELECT l_orderkey, n, r, trim(r[1]) AS a, coalesce(trim(r[2]), '') AS b, coalesce(trim(r[3]), '') AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, r) AS k, max(len(r)) OVER (PARTITION BY l_orderkey) AS w FROM c),
z AS (SELECT *, max(length(a)) OVER o AS la, greatest(max(length(b)) OVER o, 1) AS lb, greatest(max(length(d)) OVER o, 1) AS ld FROM x WINDOW o AS (PARTITION BY l_orderkey)),
l AS (SELECT *, CASE WHEN w = 1 THEN '| ' || rpad(a, CAST(la AS INTEGER), ' ') || ' |' ELSE '| ' || rpad(a, CAST(la AS INTEGER), ' ') || ' | ' || rpad(b, CAST(lb AS INTEGER), ' ') || ' | ' || rpad(d, CAST(ld AS INTEGER), ' ') || ' |' END
 || CASE WHEN k > 1 THEN '' WHEN w = 1 THEN chr(10) || '| ' || repeat('-', la) || ' |' ELSE chr(10) || '| ' || repeat('-', la) || ' | ' || repeat('-', lb) || ' | ' || repeat('-', ld) || ' |' END AS line FROM z)
SELECT l_orderkey, string_agg(line, chr(10) ORDER BY k) AS markdown FROM l GROUP BY l_orderkey""")
def table_markdown(spark, sf_dir):
    return _grids(spark, sf_dir).select("l_orderkey", tables.to_markdown(F.col("grid")).alias("markdown"))


@_query("SELECT l_suppkey AS doc_id, string_agg('### Table ' || k || ' — Page ' || l_linenumber || chr(10) || chr(10) || m, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY l_linenumber, o, k) AS listing FROM (SELECT l_suppkey, l_linenumber, l_orderkey * 100 + l_linenumber AS o, CAST(l_orderkey AS VARCHAR) AS m, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey * 100 + l_linenumber) AS k FROM lineitem) GROUP BY l_suppkey")
def table_listing(spark, sf_dir):
    d = _read(spark, sf_dir, "lineitem")
    return tables.listing(d.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("table_ord"), F.col("l_orderkey").cast("string").alias("markdown")))


@_query("SELECT doc_id, 'Table 1. x' || chr(10) || chr(10) || 'T1' || chr(10) || chr(10) || text || chr(10) || 'Tabla 2' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'T2' || chr(10) ELSE '' END AS text FROM documents")
def insert_tables(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", tables.insert_tables(F.concat(F.lit("Table 1. x\n"), "text", F.lit("\nTabla 2")), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("T1"), F.lit("T2"), F.lit("T3"))).otherwise(F.array(F.lit("T1")))).alias("text"))


@_query("WITH p AS (SELECT user_id AS image_id, CAST(event_id % 500 AS INTEGER) AS pos FROM events GROUP BY ALL), r AS (SELECT *, pos - row_number() OVER (PARTITION BY image_id ORDER BY pos) AS run FROM p) SELECT image_id, CAST(floor((min(pos) + max(pos)) / 2) AS INTEGER) AS centre FROM r GROUP BY image_id, run")
def line_centres(spark, sf_dir):
    d = _read(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), (F.col("event_id") % 500).cast("int").alias("pos")).distinct()
    return tables.line_centres(d.withColumn("share", F.lit(1.0)))


@_query("""WITH x AS (SELECT p_partkey, list_sort([0, p_size * 3, p_size * 9, 600]) AS xs FROM part),
e AS (SELECT p_partkey, list_filter([[xs[1], xs[2]], [xs[2], xs[3]], [xs[3], xs[4]]], lambda p: p[2] - p[1] >= 10) AS ps FROM x)
SELECT p_partkey, array_to_string(list_transform([[0, 40], [45, 120]], lambda q: array_to_string(list_transform(ps, lambda p: concat_ws(':', p[1] + 3, q[1] + 3, p[2] - p[1] - 6, q[2] - q[1] - 6)), ',')), ';') AS rows FROM e""")
def cell_rows(spark, sf_dir):
    d = _read(spark, sf_dir, "part")
    xs = F.array_sort(F.array(F.lit(0), (F.col("p_size") * 3).cast("int"), (F.col("p_size") * 9).cast("int"), F.lit(600)))
    d = d.select("p_partkey", tables.cell_boxes(xs, F.array(F.lit(0), F.lit(40), F.lit(45), F.lit(120))).alias("cells"))
    d = d.select("p_partkey", tables.group_rows(F.col("cells"), F.lit(1000)).alias("rows"))
    shown = lambda c: F.concat_ws(":", *[c[n].cast("string") for n in "xywh"])
    return d.select("p_partkey", F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, shown), ",")), ";").alias("rows"))


_HYPOTHESIS = "replace(text, 'é', 'e') || CASE WHEN turn % 4 = 1 THEN repeat('§', CAST(length(text) DIV 3 AS INT)) ELSE '' END"


def _sides(spark, sf_dir, lacking: bool = False):
    """Recognised pages, without accents and some with noise behind, and their references; lacking: a fifth of the pages has none."""
    d = _read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("page"), "conv_id", "text", F.expr(_HYPOTHESIS).alias("hypothesis"))
    return d.select("page", F.col("hypothesis").alias("text")), (d.where("conv_id % 5 <> 0") if lacking else d).select("page", "text")


_SIDES = f"d AS (SELECT conv_id || '-' || turn AS page, conv_id, turn, text, {_HYPOTHESIS.replace('length(text) DIV 3', 'length(text) // 3')} AS hypothesis FROM conversations), p AS (SELECT page, turn, text AS reference, hypothesis FROM d)"
_COUNT = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
_DIFF = "round(abs({0} - {1}) / greatest({0}, 1) * 100, 2)"


@_query(f"WITH {_SIDES}, x AS (SELECT page, length(reference) AS a, length(hypothesis) AS b, {_COUNT.format('reference')} AS c, {_COUNT.format('hypothesis')} AS d FROM p) SELECT page, {_DIFF.format('a', 'b')} AS char_diff, {_DIFF.format('c', 'd')} AS word_diff FROM x")
def content_counts(spark, sf_dir):
    ocr, ref = _sides(spark, sf_dir)
    return quality.content_counts(ocr.withColumnRenamed("text", "hypothesis").join(ref.withColumnRenamed("text", "reference"), "page")).select("page", "char_diff", "word_diff")


_OVERLAP = "a AS (SELECT page, w, count(*) AS n FROM (SELECT page, unnest(regexp_split_to_array(lower(strip_accents(reference)), '\\s+')) AS w FROM p) WHERE w <> '' GROUP BY ALL), b AS (SELECT page, w, count(*) AS n FROM (SELECT page, unnest(regexp_split_to_array(lower(strip_accents(hypothesis)), '\\s+')) AS w FROM p) WHERE w <> '' GROUP BY ALL), j AS (SELECT coalesce(a.page, b.page) AS page, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.page = b.page AND a.w = b.w), s AS (SELECT page, round(200.0 * sum(least(x, y)) / CAST(sum(x + y) AS DOUBLE), 6) AS overlap FROM j GROUP BY page)"


@_query(f"WITH {_SIDES}, {_OVERLAP} SELECT p.page, coalesce(CAST(s.overlap AS DOUBLE), 100.0::DOUBLE) AS overlap FROM p LEFT JOIN s ON s.page = p.page")
def word_overlap(spark, sf_dir):
    ocr, ref = _sides(spark, sf_dir)
    return quality.word_overlap(ocr.withColumnRenamed("text", "hypothesis").join(ref.withColumnRenamed("text", "reference"), "page")).select("page", F.round("overlap", 6).alias("overlap"))


@_query(f"WITH {_SIDES} SELECT page FROM d WHERE conv_id % 5 = 0")
def missing_reference(spark, sf_dir):
    return quality.missing_reference(*_sides(spark, sf_dir, True))


@_query(f"""WITH {_SIDES}, {_OVERLAP}, m AS (SELECT p.page, length(strip_accents(reference)) AS n, length(hypothesis) - length(reference) AS k, length(reference) - length(replace(reference, 'é', '')) AS lost, length(reference) AS a, length(hypothesis) AS b,
  {_COUNT.format('reference')} AS c, {_COUNT.format('hypothesis')} AS d, coalesce(s.overlap, 100.0::DOUBLE) AS raw FROM p LEFT JOIN s ON s.page = p.page),
v AS (SELECT page, {_DIFF.format('a', 'b')} AS char_diff, {_DIFF.format('c', 'd')} AS word_diff, CASE WHEN n + k = 0 THEN 100.0 ELSE 200.0 * n / (2 * n + k) END AS similarity, n AS matched, CASE WHEN n > 0 THEN round(100.0::DOUBLE * (n - lost) / n, 2) END AS diacritics, raw FROM m)
SELECT page, char_diff, word_diff, CAST(round(similarity, 2) AS DOUBLE) AS similarity, CAST(matched AS INTEGER) AS matched, CAST(diacritics AS DOUBLE) AS diacritics, CAST(round(raw, 2) AS DOUBLE) AS overlap, CASE WHEN similarity < 90 THEN 'base_similarity' ELSE '' END AS errors,
concat_ws(',', CASE WHEN char_diff > 5 THEN 'char_diff' END, CASE WHEN word_diff > 5 THEN 'word_diff' END, CASE WHEN diacritics < 70 THEN 'diacritics' END, CASE WHEN raw < 85 THEN 'overlap' END) AS warnings, similarity >= 90 AS passed FROM v""")
def page_verdict(spark, sf_dir):
    """Noise of one strange sign behind the text leaves all base letters matched, so that the similarity is known in closed form."""
    return quality.verify(*_sides(spark, sf_dir)).withColumns({"errors": F.array_join("errors", ","), "warnings": F.array_join("warnings", ",")})


@_query("""WITH m AS (SELECT l_orderkey || '-' || l_linenumber AS page, l_discount * 100 AS char_diff, l_tax * 100 AS word_diff, 70 + l_quantity AS similarity, CASE WHEN l_linenumber % 3 > 0 THEN 50 + l_quantity END AS diacritics, 60 + l_quantity AS overlap FROM lineitem)
SELECT count(*) AS pages_evaluated, count(*) FILTER (WHERE similarity >= 90) AS pages_passed, count(*) FILTER (WHERE similarity < 90) AS pages_with_errors, count(*) FILTER (WHERE char_diff > 5 OR word_diff > 5 OR coalesce(diacritics < 70, false) OR overlap < 85) AS pages_with_warnings,
round(avg(similarity), 2) AS mean_similarity, round(avg(diacritics), 2) AS mean_diacritics, round(avg(overlap), 2) AS mean_overlap, (SELECT string_agg(page, ',' ORDER BY page) FROM m WHERE page LIKE '%7-1') AS pages_skipped FROM m""")
def batch_summary(spark, sf_dir):
    d = _read(spark, sf_dir, "lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber) AS page", "l_discount * 100 AS char_diff", "l_tax * 100 AS word_diff", "70 + l_quantity AS similarity", "CASE WHEN l_linenumber % 3 > 0 THEN 50 + l_quantity END AS diacritics", "60 + l_quantity AS overlap")
    return quality.summary(quality.verdict(d), d.where("page LIKE '%7-1'").select("page")).withColumn("pages_skipped", F.array_join("pages_skipped", ","))


@_query(f"WITH {_SIDES} SELECT page || '_report.json' AS file, page, true AS whole FROM p")
def page_reports(spark, sf_dir):
    """Each page's report by the name of its file, with the fields that a reader finds in it."""
    found = quality.process_batch(*_sides(spark, sf_dir))[0]
    read = F.from_json("report", "page string, passed boolean, metrics struct<content: struct<char_diff: double, word_diff: double>, similarity: double, diacritic_integrity: struct<matched: int, diacritics: double>, overlap: double>, warnings array<string>, errors array<string>")
    d = found.select("file", read.alias("r"))
    return d.select("file", "r.page", (F.col("r.passed").isNotNull() & F.col("r.metrics.content.char_diff").isNotNull() & F.col("r.metrics.overlap").isNotNull() & F.col("r.warnings").isNotNull()).alias("whole"))
