"""Tables in recognised pages: validity, Markdown, insertion after captions, and grid geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import CAPTION, fix_grid, is_table_caption, strip


def caption_window(pages: DataFrame) -> DataFrame:
    """Adds has_caption and in_scope: a caption here or on the page before."""
    w = W.partitionBy("doc_id").orderBy("page_number")
    d = pages.withColumn("has_caption", is_table_caption(F.col("text")))
    return d.withColumn("in_scope", F.col("has_caption") | F.lag("has_caption", 1, False).over(w))


def bind(c: Column, f) -> Column:
    """f of a column that is evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _most_common(widths: Column) -> Column:
    """How often the commonest width occurs, and the width, by one walk over them in order; ties don't matter to the tests below."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("n"), F.lit(0).alias("width"))

    def step(a, x):
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1))
        more = run > a["n"]
        return F.struct(x.alias("last"), run.alias("run"), F.when(more, run).otherwise(a["n"]).alias("n"), F.when(more, x).otherwise(a["width"]).alias("width"))

    return F.aggregate(F.array_sort(widths), start, step)


def filled_share(grid: Column) -> Column:
    cells = F.flatten(grid)
    return F.coalesce(F.try_divide(F.size(F.filter(cells, lambda c: strip(F.coalesce(c, F.lit(""))) != "")).cast("double"), F.size(cells)), F.lit(0.0))


def is_real_table(grid: Column, share: float = 0.75, least: int = 0, filled: float | None = 0.5) -> Column:
    """Three rows or more, a commonest width of two or more that enough rows have, and enough filled cells."""
    n = F.size(grid)
    ok = (n >= 3) & bind(_most_common(F.transform(grid, F.size)), lambda top: (top["width"] >= 2) & (top["n"] >= F.greatest(F.lit(float(least)), share * n)))
    if filled is not None:
        ok = ok & (filled_share(grid) >= filled)
    return F.coalesce(ok, F.lit(False))


def is_valid_grid(grid: Column) -> Column:
    """The test for cells found in an image: four fifths of the rows, two at least, and six cells."""
    return is_real_table(grid, 0.8, 2, None) & (F.size(F.flatten(grid)) >= 6)


def to_markdown(grid: Column) -> Column:
    """Rows of cells as a Markdown table: padded, left-justified, the first row above dashes; empty for no rows or no cells.

    A column's width is folded row by row, and each row is zipped with the widths: every cell is looked at twice, whatever the grid's shape.
    """
    empty = F.array().cast("array<int>")
    wider = lambda a, r: F.zip_with(a, r, lambda n, c: F.greatest(F.coalesce(n, F.lit(1)), F.coalesce(F.length(c), F.lit(1))))
    line = lambda r, sizes: F.concat(F.lit("| "), F.array_join(F.zip_with(sizes, r, lambda n, c: F.rpad(F.coalesce(c, F.lit("")), n, F.lit(" "))), " | "), F.lit(" |"))

    def drawn(s):
        cells, sizes = s["cells"], s["sizes"]
        dashes = F.concat(F.lit("| "), F.array_join(F.transform(sizes, lambda n: F.repeat(F.lit("-"), n)), " | "), F.lit(" |"))
        lines = F.transform(cells, lambda r, k: F.when(k == 0, F.concat(line(r, sizes), F.lit("\n"), dashes)).otherwise(line(r, sizes)))
        return F.when(F.size(sizes) == 0, "").otherwise(F.array_join(lines, "\n"))

    stripped = F.transform(F.coalesce(grid, F.array().cast("array<array<string>>")), lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: strip(F.coalesce(c, F.lit("")))))
    return bind(bind(stripped, lambda cells: F.struct(cells.alias("cells"), F.aggregate(cells, empty, wider).alias("sizes"))), drawn)


#: A stretch of text up to the end of the line in which its caption ends.
_TO_CAPTION = rf"(?s:.*?)(?:{CAPTION})[^\n]*"


def insert_tables(text: Column, tables: Column) -> Column:
    """After the whole line of the i-th caption, the i-th table; tables without a caption are left out."""
    parts = F.regexp_extract_all(text, F.lit(_TO_CAPTION), F.lit(0))

    def put(p):
        read = F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x))
        both = F.zip_with(p, F.slice(tables, 1, F.size(p)), lambda x, t: F.concat(x, F.coalesce(F.concat(F.lit("\n\n"), t, F.lit("\n")), F.lit(""))))
        return F.concat(F.array_join(both, ""), F.substring(text, read + 1, F.length(text)))

    return F.when((F.coalesce(F.size(tables), F.lit(0)) < 1) | ~is_table_caption(text), text).otherwise(bind(parts, put))


def with_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """The pages with their tables (doc_id, page_number, table_ord, markdown) inserted after the captions; pages without tables as they are."""
    lists = tables.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_ord", "markdown"))), lambda t: t["markdown"]).alias("__tables"))
    both = pages.join(lists, ["doc_id", "page_number"], "left")
    return both.withColumn("text", insert_tables(F.col("text"), F.col("__tables"))).drop("__tables").select(*pages.columns)


def _rendered(found: DataFrame) -> DataFrame:
    """doc_id, page_number, table_ord, markdown of corrected grids; table_ord counts a page's tables from 1."""
    drawn = found.withColumn("markdown", to_markdown(F.col("grid"))).where("markdown <> ''")
    w = W.partitionBy("doc_id", "page_number").orderBy("table_ord")
    return drawn.select("doc_id", "page_number", F.row_number().over(w).alias("table_ord"), "markdown")


def _in_scope(pages: DataFrame) -> DataFrame:
    return caption_window(pages).where("in_scope").select("doc_id", "page_number")


def extract_digital(pages: DataFrame, grids: DataFrame, correct: bool = True) -> DataFrame:
    """Tables of pages with text: grids (doc_id, page_number, table_ord, grid) that a provider read, on pages with a caption there or on the
    page before, that are real tables; cells are corrected and the tables drawn."""
    found = grids.join(_in_scope(pages), ["doc_id", "page_number"], "left_semi").where(is_real_table(F.col("grid")))
    return _rendered(found.withColumn("grid", fix_grid(F.col("grid"))) if correct else found)


def extract_scanned(pages: DataFrame, images: DataFrame, recognize, correct: bool = True) -> DataFrame:
    """Tables of scanned pages, one a page at most: on pages in a caption's scope, the ruled grid of the image, its cells read by
    recognize(pixels, mode), corrected, and at least half of them filled. images: doc_id, page_number, width, height, pixels."""
    from quillspark.operators import images as drawn

    scope = images.join(_in_scope(pages), ["doc_id", "page_number"], "left_semi")
    found = drawn.recognized(scope, recognize).withColumn("table_ord", F.lit(1))
    found = found.withColumn("grid", fix_grid(F.col("grid"))) if correct else found
    return _rendered(found.where(filled_share(F.col("grid")) >= 0.5))


def extract_tables(kind: str, pages: DataFrame, grids: DataFrame | None = None, images: DataFrame | None = None, recognize=None) -> DataFrame:
    """One entry for both kinds of document."""
    if kind == "digital":
        return extract_digital(pages, grids)
    if kind != "scanned":
        raise ValueError(f"a document is digital or scanned, not {kind!r}")
    if images is None or recognize is None:
        raise ValueError("scanned documents need images and a recognizer")
    return extract_scanned(pages, images, recognize)


def table_totals(tables: DataFrame) -> DataFrame:
    """doc_id, n_tables, and pages: page numbers in order with each page's number of tables."""
    each = tables.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("n_tables"), F.array_sort(F.collect_list(F.struct("page_number", "n"))).alias("pages"))


def listing(tables: DataFrame) -> DataFrame:
    """doc_id, listing: titled tables in order of page and place."""
    w = W.partitionBy("doc_id", "page_number").orderBy("table_ord")
    titled = tables.withColumn("k", F.row_number().over(w))
    titled = titled.withColumn("title", F.concat(F.lit("### Table "), F.col("k").cast("string"), F.lit(" — Page "), F.col("page_number").cast("string"), F.lit("\n\n"), F.col("markdown")))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "table_ord", "k", "title")))
    return titled.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda t: t["title"]), "\n\n---\n\n").alias("listing"))


def line_centres(profile: DataFrame, covered: float = 0.6) -> DataFrame:
    """image_id, centre: middles of the runs of positions whose share of dark pixels is enough (gaps and islands)."""
    on = profile.where(F.col("share") >= covered)
    run = on.withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy("image_id").orderBy("pos")))
    return run.groupBy("image_id", "run").agg(F.floor((F.min("pos") + F.max("pos")) / 2).cast("int").alias("centre")).drop("run")


def cell_boxes(xs: Column, ys: Column, least: int = 10, inset: int = 3) -> Column:
    """Boxes between neighbouring lines, sides under `least` left out, drawn in by `inset`."""
    pairs = lambda a: F.filter(F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda s: s["q"].isNotNull() & (s["q"] - s["p"] >= least))
    box = lambda y, x: F.struct((x["p"] + inset).alias("x"), (y["p"] + inset).alias("y"), (x["q"] - x["p"] - 2 * inset).alias("w"), (y["q"] - y["p"] - 2 * inset).alias("h"))
    return F.flatten(F.transform(pairs(ys), lambda y: F.transform(pairs(xs), lambda x: box(y, x))))


def group_rows(cells: Column, height: Column) -> Column:
    """Boxes in rows: a box belongs to a row while its y is within a tolerance of the row's first; rows are in order of x."""
    tolerance = F.greatest((height * 0.025).cast("int"), F.lit(8))
    ordered = F.array_sort(F.transform(cells, lambda c: F.struct(c["y"].alias("y"), c["x"].alias("x"), c["w"].alias("w"), c["h"].alias("h"))))
    kind = "array<array<struct<y:int,x:int,w:int,h:int>>>"
    rows = F.aggregate(ordered, F.array().cast(kind), lambda a, c: F.when(
        (F.size(a) > 0) & (F.abs(c["y"] - F.get(F.get(a, F.size(a) - 1), F.lit(0))["y"]) <= tolerance),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.get(a, F.size(a) - 1), F.array(c)))),
    ).otherwise(F.concat(a, F.array(F.array(c)))))
    return F.transform(rows, lambda r: F.array_sort(F.transform(r, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["w"].alias("w"), c["h"].alias("h")))))
