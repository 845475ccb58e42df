import random

import numpy as np

from quillspark.operators import images


def page(rows, cols, frame_only=False, edge=40):
    """Cells of 100 x 60 with lines two pixels wide."""
    h, w = rows * 60 + 2 * edge, cols * 100 + 2 * edge
    g = np.full((h, w), 255, np.uint8)
    for k in range(rows + 1):
        if not frame_only or k in (0, rows):
            g[edge + 60 * k : edge + 60 * k + 2, edge : edge + 100 * cols + 2] = 0
    for k in range(cols + 1):
        if not frame_only or k in (0, cols):
            g[edge : edge + 60 * rows + 2, edge + 100 * k : edge + 100 * k + 2] = 0
    return g


def test_openings_and_groups_against_brute_force():
    rnd = np.random.default_rng(5)
    for _ in range(30):
        m = rnd.random((9, 12)) < 0.6
        n = int(rnd.integers(2, 5))
        left = n // 2
        want = np.zeros_like(m)
        for y in range(9):
            for x in range(12):
                window = [k for k in range(x - left, x - left + n) if 0 <= k < 12]
                if m[y, window].all():
                    want[y, window] = True
        assert (images.opened(m, n, 1) == want).all()
        left_over, found = {(int(y), int(x)) for y, x in zip(*np.nonzero(m))}, []
        while left_over:
            todo, seen = [left_over.pop()], []
            while todo:
                y, x = todo.pop()
                seen.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left_over
                left_over -= near
                todo += near
            ys, xs = zip(*seen)
            found.append([min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1])
        assert sorted(images.boxes(m).tolist()) == sorted(found)


def test_threshold_and_specks():
    g = np.full((20, 20), 200, np.uint8)
    g[5:9, 5:9], g[15, 15] = 30, 30
    got = images.cleaned(g)
    assert 30 <= images.threshold(g) < 200 and (got[5:9, 5:9] == 0).all() and (got == 0).sum() == 16
    assert (images.cleaned(np.full((5, 5), 255, np.uint8)) == 255).all()


def test_grids(spark):
    ruled, frame = page(4, 3), page(4, 3, frame_only=True)
    small = np.full((2000, 2000), 255, np.uint8)
    small[100 : 100 + ruled.shape[0], 100 : 100 + ruled.shape[1]] = ruled  # lines shorter than a quarter of the page
    data = [("ruled", ruled.shape[1], ruled.shape[0], ruled.tobytes()), ("frame", frame.shape[1], frame.shape[0], frame.tobytes()), ("small", 2000, 2000, small.tobytes()),
            ("null", 10, 10, None), ("short", 10, 10, b"abc"), ("size", None, 10, b"abc"), ("zero", 0, 0, b"")]
    random.Random(1).shuffle(data)
    d = spark.createDataFrame(data, "image_id string, width int, height int, pixels binary").selectExpr("*", "1 AS extra")
    got = {r["image_id"]: r for r in images.table_grids(d).collect()}
    assert len(got) == 7 and [k for k, r in got.items() if r["valid"]] == ["ruled"]
    assert [len(r) for r in got["ruled"]["grid"]] == [3, 3, 3, 3]
    x, y, w, h = got["ruled"]["box"]
    assert abs(x - 34) <= 1 and abs(y - 34) <= 1 and abs(w - 314) <= 1 and abs(h - 254) <= 1
    assert all(r["box"] is None for k, r in got.items() if k != "ruled")
    plain = {r["image_id"]: r["pixels"] for r in images.binarized(d).collect()}
    assert len(plain["ruled"]) == ruled.size and plain["null"] is None and plain["short"] is None
    assert images.table_grids(d.limit(0)).count() == 0


def test_recognized_moves_no_pixels(spark):
    """Repeated pages and null ids give a row each, and no join, shuffle or broadcast holds the images."""
    from pyspark.sql import functions as F

    ruled = page(4, 3)
    data = [(d, 2, ruled.shape[1], ruled.shape[0], p) for d, p in [(1, ruled.tobytes()), (1, ruled.tobytes()), (2**60 + 1, ruled.tobytes()), (None, ruled.tobytes()), (5, None)]]
    found = images.recognized(spark.createDataFrame(data, "doc_id long, page_number int, width int, height int, pixels binary"), lambda pixels, mode: f" {mode}{pixels.shape[0]}\n")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = found.withColumn("cells", F.flatten("grid")).collect()
    assert sorted((r["doc_id"] or 0, r["page_number"], len(r["grid"]), len(r["cells"])) for r in got) == [(0, 2, 4, 12), (1, 2, 4, 12), (1, 2, 4, 12), (2**60 + 1, 2, 4, 12)]
    assert len({x for r in got for x in r["cells"]}) == 1
