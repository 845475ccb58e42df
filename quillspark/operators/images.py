"""Scanned pages before recognition: binarization, ruled lines, and the place of a table.

Images are rows of image_id, width, height and pixels (8-bit grey, row after row). Spark has no expression over pixels, so an image is
worked on in numpy, one at a time, out of Arrow batches that Spark bounds in bytes (spark.sql.execution.arrow.maxBytesPerBatch); what leaves is small (a box and line positions) and feeds the column expressions of
operators.tables. An image without a table, with null pixels, or with fewer or more pixels than width x height has a null box and no lines.

Openings are the mathematical ones, with what lies outside the image counted as ink, so a line may run off the page. Of boxes
with equally many crossings the larger is taken, then the upper, then the left one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quillspark.operators import tables

#: Least line length in pixels and as a fraction of the side, crossings, lines of either kind, share of the page, joining reach, covered share.
LEAST_LINE, LINE_PART, CROSSINGS, ACROSS, DOWN, AREA, REACH, COVERED = 60, 4, 9, 4, 3, 0.02, 6, 0.6


def threshold(grey: np.ndarray) -> int:
    """Otsu's: the grey level that parts the histogram with the greatest variance between the classes."""
    n = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(below * above * (mass / below - (mass[-1] - mass) / above) ** 2)
    return int(between.argmax())


def _counted(mask: np.ndarray, n: int, axis: int, before: int, outside: int) -> np.ndarray:
    """How many of the n pixels from `before` pixels before each one are set."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (before + 1, n - 1 - before)
    sums = np.cumsum(np.pad(mask.astype(np.int32), pad, constant_values=outside), axis=axis)
    size = mask.shape[axis]
    return np.take(sums, np.arange(n, n + size), axis) - np.take(sums, np.arange(size), axis)


def opened(mask: np.ndarray, n: int, axis: int) -> np.ndarray:
    left = n // 2
    core = _counted(mask, n, axis, left, 1) == n
    return _counted(core, n, axis, n - 1 - left, 0) > 0


def cleaned(grey: np.ndarray) -> np.ndarray:
    """Black on white, without specks that hold no 2 x 2 square."""
    ink = grey <= threshold(grey)
    core = _counted(_counted(ink, 2, 0, 1, 1) == 2, 2, 1, 1, 1) == 2
    kept = _counted(_counted(core, 2, 0, 0, 0) > 0, 2, 1, 0, 0) > 0
    return np.where(kept, 0, 255).astype(np.uint8)


def ruled(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the lines across and down: runs of ink of a quarter of the side at least."""
    ink, (h, w) = grey <= threshold(grey), grey.shape
    return opened(ink, max(w // LINE_PART, LEAST_LINE), 1), opened(ink, max(h // LINE_PART, LEAST_LINE), 0)


def boxes(mask: np.ndarray) -> np.ndarray:
    """x, y, w, h of every group of touching pixels, diagonals included: runs of each line, joined with those of the line above."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    if not len(row):
        return np.zeros((0, 4), np.int64)
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1)).tolist()
    a, z = start.tolist(), stop.tolist()
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if a[i] <= z[j] and a[j] <= z[i]:
                parent[root(j)] = root(i)
            if z[i] < z[j]:
                i += 1
            else:
                j += 1
    group = np.unique([root(i) for i in range(len(row))], return_inverse=True)[1]
    n = group.max() + 1
    low, high = np.full((2, n), max(mask.shape)), np.zeros((2, n), np.int64)
    for side, (lower, upper) in enumerate(((start, stop), (row, row + 1))):
        np.minimum.at(low[side], group, lower)
        np.maximum.at(high[side], group, upper)
    return np.stack([low[0], low[1], high[0] - low[0], high[1] - low[1]], 1)


def table_box(grey: np.ndarray) -> tuple[int, int, int, int] | None:
    """The box with the most crossings of ruled lines, if there are lines and crossings enough and it isn't small."""
    across, down = ruled(grey)
    crossings = across & down
    if crossings.sum() < CROSSINGS or len(boxes(across)) < ACROSS or len(boxes(down)) < DOWN:
        return None
    reach = 2 * REACH + 1
    joined = _counted(_counted(across | down, reach, 0, REACH, 0) > 0, reach, 1, REACH, 0) > 0
    n, _, y, x, w, h = max((int(crossings[y : y + h, x : x + w].sum()), w * h, -y, -x, w, h) for x, y, w, h in boxes(joined).tolist())
    return (-x, -y, w, h) if n >= CROSSINGS and w * h >= AREA * grey.size else None


def centres(lines: np.ndarray, axis: int) -> list[int]:
    """Middles of the runs of rows (axis 1 is summed) or columns (axis 0) that lines cover for the most part."""
    on = lines.sum(axis) >= COVERED * lines.shape[axis]
    edge = np.diff(np.pad(on.astype(np.int8), 1))
    return ((np.flatnonzero(edge == 1) + np.flatnonzero(edge == -1) - 1) // 2).tolist()


def _grey(pixels, width, height) -> np.ndarray | None:
    if pixels is None or not width or not height or len(pixels) != width * height:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(height, width)


def _each(images: DataFrame, result, kind: str, keep, also=()) -> DataFrame:
    """The columns keep as they are, then those of kind: what result(grey image or None, *also) gives, one image at a time. Nothing is joined, so pixels stay in their task."""
    names = list(dict.fromkeys(["width", "height", "pixels", *keep, *also]))
    given, new = images.select(*names), StructType.fromDDL(kind)
    arrow, at = to_arrow_schema(new), {c: k for k, c in enumerate(names)}

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                value = lambda c: one.column(at[c])[0].as_py()  # noqa: B023, E731
                w, h = value("width"), value("height")
                grey = None if w is None or h is None or w != w or h != h else _grey(value("pixels"), int(w), int(h))
                made = [pa.array([v], f.type) for v, f in zip(result(grey, *[value(c) for c in also]), arrow)]
                yield pa.RecordBatch.from_arrays([*[one.column(at[c]) for c in keep], *made], [*keep, *arrow.names])

    return given.mapInArrow(run, StructType([StructField(c, given.schema[at[c]].dataType) for c in keep] + new.fields))


def _identified(images: DataFrame) -> DataFrame:
    return images.withColumn("image_id", F.col("image_id").cast("string"))


def binarized(images: DataFrame) -> DataFrame:
    """image_id, pixels: the images in black and white, specks gone; null where an image isn't whole."""
    return _each(_identified(images), lambda g: [None if g is None else cleaned(g).tobytes()], "pixels binary", ["image_id"])


def _regions(images: DataFrame, keep) -> DataFrame:
    def result(g):
        box = None if g is None else table_box(g)
        if box is None:
            return None, [], []
        x, y, w, h = box
        across, down = ruled(g[y : y + h, x : x + w])
        return dict(zip("xywh", box)), centres(down, 0), centres(across, 1)

    return _each(images, result, "box struct<x:int,y:int,w:int,h:int>, xs array<int>, ys array<int>", keep)


def ruled_regions(images: DataFrame) -> DataFrame:
    """image_id, box, xs, ys: the table's place on each image, and its lines' middles within the box."""
    return _regions(_identified(images), ["image_id"])


def _gridded(d: DataFrame, keep) -> DataFrame:
    d = d.withColumn("grid", tables.group_rows(tables.cell_boxes(F.col("xs"), F.col("ys")), F.col("box.h")))
    shaped = F.transform("grid", lambda r: F.transform(r, lambda c: c["x"].cast("string")))
    return d.select(*keep, "box", "grid", (F.col("box").isNotNull() & tables.is_valid_grid(shaped)).alias("valid"))


def table_grids(images: DataFrame) -> DataFrame:
    """image_id, box, grid, valid: rows of cells, in the box's coordinates, ready for a recognizer."""
    return _gridded(ruled_regions(images), ["image_id"])


#: The border around a cell, and the height from which a cell is read as a block (mode 6) and not as a line (mode 7).
BORDER, BLOCK_HEIGHT = 6, 60


def recognized(images: DataFrame, recognize) -> DataFrame:
    """doc_id, page_number, grid: the texts of the valid grids' cells, read by recognize(pixels, mode) from the cleaned image with a white border.

    One row an image, repeated pages and null ids included: an image goes on with its grid and isn't looked up again by its page, so no
    shuffle or broadcast holds pixels.
    """
    keep = ["doc_id", "page_number", "width", "height", "pixels"]
    found = _gridded(_regions(images, keep), keep).where("valid")

    def read(grey, box, grid):
        page = cleaned(grey)
        rows = [[page[box["y"] + c["y"] :, box["x"] + c["x"] :][: c["h"], : c["w"]] for c in row] for row in grid]
        return ([[recognize(np.pad(c, BORDER, constant_values=255), 7 if c.shape[0] < BLOCK_HEIGHT else 6).strip() for c in row] for row in rows],)

    return _each(found, read, "grid array<array<string>>", ["doc_id", "page_number"], ["box", "grid"])
