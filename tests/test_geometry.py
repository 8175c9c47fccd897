"""Boxes and page geometry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import bbox as B
from foliospark.functions import geometry as G

f32 = np.float32


def sizes(spark, rows):
    return spark.createDataFrame(rows, "w int, h int")


def test_target_size(spark):
    want = {(2480, 3508): (2492, 3500), (1000, 1400): (1540, 2156), (1554, 1554): (1568, 1568),
            (1582, 1582): (1568, 1568), (3000, 20): (230412, 1540)}
    df = sizes(spark, list(want)).select("w", "h", G.target_size(F.col("w"), F.col("h")).alias("t"))
    assert {(r.w, r.h): tuple(r.t) for r in df.collect()} == want


def loop_grid(w, h):
    best, low = (1, 1), f32(np.finfo(f32).max)
    ratio = f32(w) / f32(h)
    for c, r in G.GRIDS:
        error = abs(f32(ratio - f32(c) / f32(r)))
        if error < low:
            low, best = error, (c, r)
        elif abs(f32(error - low)) < f32(0.0001) and c * r > best[0] * best[1]:
            if f32(w) * f32(h) > f32(0.5) * f32(c * r * 768 * 768):
                best = (c, r)
    return best


def test_best_grid(spark):
    known = {(1536, 2172): (2, 3), (2480, 3508): (2, 3), (1750, 1000): (2, 1), (3500, 2000): (3, 2),
             (1000, 1000): (2, 2), (700, 4200): (1, 6)}
    pairs = list(known) + [(w, h) for w in range(90, 4000, 410) for h in range(70, 5000, 333)]
    got = {(r.w, r.h): tuple(r.grid) for r in G.with_best_grid(sizes(spark, pairs), "w", "h").collect()}
    assert all(got[k] == v for k, v in known.items())
    assert all(got[p] == loop_grid(*p) for p in pairs)


def test_tiles(spark):
    df = G.with_best_grid(sizes(spark, [(3500, 2000)]), "w", "h")
    r = df.select(G.combined_size(F.col("grid")).alias("c"), G.tile_rects(F.col("grid")).alias("t")).first()
    assert tuple(r.c) == (2304, 2560) and len(r.t) == 6
    assert tuple(r.t[4]) == (1, 1, 768, 768, 768, 1792)


def test_crop_and_letterbox(spark):
    df = spark.createDataFrame([([-5.0, 10.0, 50.0, 30.0],), ([90.0, 0.0, 200.0, 10.0],),
                                ([50.0, 50.0, 40.0, 60.0],), ([1e30, 0.0, 1.0, 1.0],)], "b array<float>")
    got = [r.c and tuple(r.c) for r in df.select(G.crop_rect(F.col("b"), F.lit(100), F.lit(100)).alias("c")).collect()]
    assert got == [(0, 10, 55, 20), (90, 0, 10, 10), None, None]
    box = sizes(spark, [(2000, 1000), (0, 5)]).select(G.letterbox(F.col("w"), F.col("h")).alias("v")).collect()
    assert tuple(box[0].v) == (1024, 512, 0, 256)


@pytest.mark.parametrize("angle", [0, 90, 180, 270, -90, 45])
def test_rotated_size(spark, angle):
    got = sizes(spark, [(300, 200)]).select(
        G.rotated_size(F.col("w"), F.col("h"), F.lit(angle)).alias("v")).first().v
    cos, sin = (abs(f32(fn(angle * math.pi / 180))) for fn in (math.cos, math.sin))
    assert tuple(got) == (int(f32(300) * cos + f32(200) * sin), int(f32(300) * sin + f32(200) * cos))


def test_boxes(spark):
    df = spark.createDataFrame([([0.0, 0.0, 999.0, 999.0],), ([1.0, 2.0],), (None,), ([-9.0, 3.0, 2000.0, 5.0],)],
                               "b array<float>")
    b, w, h = F.col("b"), F.lit(1000), F.lit(2000)
    got = df.select(B.scale_999(b, w, h).alias("d"), B.scale_1024(b, w, h).alias("c"),
                    B.scale_by(b.cast("array<int>"), F.lit(0.5), F.lit(2.0)).alias("s"),
                    B.corner(b, 3).alias("y2"), B.four_or_null(b).alias("f"),
                    B.union(F.array(b, b)).alias("u")).collect()
    assert list(got[0].d) == [0, 0, 1000, 2000]
    assert list(got[1].d) == [0, 0, 0, 0] and got[1].c is None and list(got[1].s) == [1, 2]
    assert list(got[3].c)[0] == 0 and list(got[3].c)[2] == 1000
    assert list(got[3].s) == [-4, 6, 1000, 10]
    assert [r.y2 for r in got] == [999, 0, 0, 5]
    assert got[1].f is None and list(got[3].u) == [-9, 3, 2000, 5]
    assert list(spark.range(1).select(B.union(F.array().cast("array<array<float>>")).alias("u")).first().u) == [0] * 4
