"""Page-image geometry: sizes, crops, letterbox and tile grids. No pixels are touched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.bbox import as_float
from foliospark.functions.columns import let

# Candidate grids (columns, rows) in trial order, tile and global view side.
GRIDS = ((1, 2), (2, 1), (1, 3), (3, 1), (2, 2), (2, 3), (3, 2),
         (1, 4), (4, 1), (1, 5), (5, 1), (1, 6), (6, 1))
TILE = 768
GLOBAL = 1024
MIN_SIDE = 1536
PATCH = 28


def target_size(width: Column, height: Column, min_side: int = MIN_SIDE) -> Column:
    """struct(width, height) after the minimum-side rule and rounding to the patch multiple."""
    small = F.least(width, height)
    factor = as_float(F.try_divide(F.lit(float(min_side)), as_float(small)))

    def side(v: Column) -> Column:
        grown = F.when(small < min_side, as_float(as_float(v) * factor).cast("int")).otherwise(v)
        return F.greatest(F.lit(PATCH), F.rint(grown / float(PATCH)).cast("int") * PATCH)

    return F.struct(side(width).alias("width"), side(height).alias("height"))


def rotated_size(width: Column, height: Column, degrees: Column) -> Column:
    """struct(width, height) of the canvas that holds the page turned by ``degrees``."""
    angle = degrees * F.lit(3.141592653589793) / F.lit(180.0)
    cos, sin = F.abs(as_float(F.cos(angle))), F.abs(as_float(F.sin(angle)))
    w, h = as_float(width), as_float(height)
    return F.struct(as_float(w * cos + h * sin).cast("int").alias("width"),
                    as_float(w * sin + h * cos).cast("int").alias("height"))


def crop_rect(bbox: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h) of a crop inside the page, null when nothing is left.

    The extent is the one of the unclamped corners, limited by the page.
    """
    x1, y1, x2, y2 = (F.get(bbox, F.lit(i)).try_cast("int") for i in range(4))
    x, y = F.greatest(F.lit(0), x1), F.greatest(F.lit(0), y1)
    w, h = F.least(width - x, x2 - x1), F.least(height - y, y2 - y1)
    rect = F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    readable = (F.size(bbox) == 4) & x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(readable & (w > 0) & (h > 0), rect)


def letterbox(width: Column, height: Column) -> Column:
    """struct(width, height, x, y): size and offset of the page inside the square global view."""
    scale = F.least(as_float(F.try_divide(F.lit(float(GLOBAL)), width)),
                    as_float(F.try_divide(F.lit(float(GLOBAL)), height)))
    size = F.struct(as_float(as_float(width) * scale).cast("int").alias("w"),
                    as_float(as_float(height) * scale).cast("int").alias("h"))
    return let(size, lambda s: F.struct(
        s["w"].alias("width"), s["h"].alias("height"),
        F.floor((F.lit(GLOBAL) - s["w"]) / 2).cast("int").alias("x"),
        F.floor((F.lit(GLOBAL) - s["h"]) / 2).cast("int").alias("y")))


def with_best_grid(df: DataFrame, width: str, height: str) -> DataFrame:
    """Add ``grid`` = struct(cols, rows): the candidate grid nearest in aspect ratio.

    Candidates are tried in order; one that ties with the best so far wins only if it has more
    tiles and the page covers more than half of its pixels. Each trial is one projection, so the
    whole fold is generated code.
    """
    w, h = as_float(F.col(width)), as_float(F.col(height))
    state = df.select(
        "*", as_float(F.try_divide(w, h)).alias("_ratio"), as_float(w * h).alias("_area"),
        F.lit(1).alias("_cols"), F.lit(1).alias("_rows"),
        as_float(F.lit(3.4028234663852886e38)).alias("_error"))
    for cols, rows in GRIDS:
        error = F.abs(as_float(F.col("_ratio") - as_float(as_float(F.lit(cols)) / F.lit(rows))))
        nearer = error < F.col("_error")
        tie = F.abs(as_float(error - F.col("_error"))) < as_float(F.lit(0.0001))
        larger = F.col("_cols") * F.col("_rows") < cols * rows
        covers = F.col("_area") > as_float(F.lit(0.5 * cols * rows * TILE * TILE))
        wins = nearer | (tie & larger & covers)
        state = state.select(
            *df.columns, "_ratio", "_area",
            F.when(wins, cols).otherwise(F.col("_cols")).alias("_cols"),
            F.when(wins, rows).otherwise(F.col("_rows")).alias("_rows"),
            F.when(nearer, error).otherwise(F.col("_error")).alias("_error"))
    return state.select(*df.columns, F.struct(
        F.col("_cols").alias("cols"), F.col("_rows").alias("rows")).alias("grid"))


def combined_size(grid: Column) -> Column:
    """struct(width, height) of the canvas holding the global view above the tile group."""
    return F.struct(F.greatest(F.lit(GLOBAL), grid["cols"] * TILE).alias("width"),
                    (grid["rows"] * TILE + GLOBAL).alias("height"))


def tile_rects(grid: Column) -> Column:
    """array of struct(row, col, src_x, src_y, dst_x, dst_y), one per tile, row by row."""
    left = F.floor((combined_size(grid)["width"] - grid["cols"] * TILE) / 2).cast("int")
    cells = F.sequence(F.lit(0), grid["cols"] * grid["rows"] - 1)

    def place(k: Column) -> Column:
        row = F.floor(k / grid["cols"]).cast("int")
        col = (k % grid["cols"]).cast("int")
        return F.struct(row.alias("row"), col.alias("col"),
                        (col * TILE).alias("src_x"), (row * TILE).alias("src_y"),
                        (left + col * TILE).alias("dst_x"), (row * TILE + GLOBAL).alias("dst_y"))

    return F.transform(cells, place)
