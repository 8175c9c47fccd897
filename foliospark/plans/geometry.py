"""Geometry queries over page sizes taken from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.plans import fixtures as X

DIMS = X.cte("d", "lineitem", X.DIM_COLS)
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_KEYS = ", ".join(KEYS)


def _dims(spark: SparkSession, sf: str) -> DataFrame:
    return X.view(spark, sf, "lineitem", X.DIM_COLS)


def _with(spark: SparkSession, sf: str, value, *fields: str) -> DataFrame:
    return _dims(spark, sf).withColumn("v", value).select(
        *KEYS, *[F.col(f"v.{f}").alias(f) for f in fields])


def target_size(spark: SparkSession, sf: str) -> DataFrame:
    return _with(spark, sf, G.target_size(F.col("width"), F.col("height")), "width", "height")


def _target(side: str) -> str:
    grown = (f"CASE WHEN small < 1536 THEN trunc(CAST({side} AS FLOAT) * "
             f"CAST(CAST(1536 AS FLOAT) / CAST(small AS FLOAT) AS FLOAT)) ELSE {side} END")
    return f"greatest(28, CAST(round_even(({grown}) / CAST(28 AS DOUBLE), 0) AS INT) * 28) AS {side}"


TARGET_SQL = (f"WITH {DIMS}, s AS (SELECT *, least(width, height) AS small FROM d) "
              f"SELECT {_KEYS}, {_target('width')}, {_target('height')} FROM s")


def rotated_size(spark: SparkSession, sf: str) -> DataFrame:
    return _with(spark, sf, G.rotated_size(F.col("width"), F.col("height"), F.col("degrees")),
                 "width", "height")


ROTATED_SQL = f"""WITH {DIMS} SELECT {_KEYS},
CASE WHEN degrees % 180 = 90 THEN height ELSE width END AS width,
CASE WHEN degrees % 180 = 90 THEN width ELSE height END AS height FROM d"""


def crop_rect(spark: SparkSession, sf: str) -> DataFrame:
    box = F.array(*[v.cast("float") for v in (
        F.col("l_partkey") % 300 - 60, F.col("l_suppkey") % 200 - 20,
        F.col("l_partkey") % 900, F.col("l_suppkey") * 13 % 700)])
    rows = _dims(spark, sf).withColumn("v", G.crop_rect(box, F.col("width"), F.col("height")))
    return rows.filter(F.col("v").isNotNull()).select(*KEYS, *[f"v.{f}" for f in "xywh"])


CROP_SQL = f"""WITH {DIMS}, c AS (SELECT *, CAST(l_partkey % 300 - 60 AS INT) AS x1, CAST(l_suppkey % 200 - 20 AS INT) AS y1,
CAST(l_partkey % 900 AS INT) AS x2, CAST(l_suppkey * 13 % 700 AS INT) AS y2 FROM d),
r AS (SELECT {_KEYS}, greatest(0, x1) AS x, greatest(0, y1) AS y, least(width - greatest(0, x1), x2 - x1) AS w,
least(height - greatest(0, y1), y2 - y1) AS h FROM c) SELECT * FROM r WHERE w > 0 AND h > 0"""


def letterbox(spark: SparkSession, sf: str) -> DataFrame:
    return _with(spark, sf, G.letterbox(F.col("width"), F.col("height")), "width", "height", "x", "y")


LETTERBOX_SQL = f"""WITH {DIMS}, s AS (SELECT *, least(CAST(CAST(1024 AS FLOAT) / CAST(width AS FLOAT) AS FLOAT),
CAST(CAST(1024 AS FLOAT) / CAST(height AS FLOAT) AS FLOAT)) AS k FROM d),
t AS (SELECT {_KEYS}, CAST(trunc(CAST(width AS FLOAT) * k) AS INT) AS width,
CAST(trunc(CAST(height AS FLOAT) * k) AS INT) AS height FROM s)
SELECT *, (1024 - width) // 2 AS x, (1024 - height) // 2 AS y FROM t"""

# Replayed over the ordered candidate list; the error is in single precision on both sides.
_GRID = f"""{DIMS},
cand AS (SELECT k, cols, rws FROM (SELECT unnest({[c for c, _ in G.GRIDS]}) AS cols,
  unnest({[r for _, r in G.GRIDS]}) AS rws, unnest(range(1, {len(G.GRIDS) + 1})) AS k)),
sizes AS (SELECT DISTINCT width, height FROM d),
play AS (
  SELECT width, height, CAST(0 AS BIGINT) AS k, 1 AS cols, 1 AS rws, CAST('inf' AS FLOAT) AS best FROM sizes
  UNION ALL
  SELECT width, height, k, CASE WHEN win THEN nc ELSE cols END, CASE WHEN win THEN nr ELSE rws END,
         CASE WHEN err < best THEN err ELSE best END
  FROM (SELECT p.width, p.height, c.k, p.cols, p.rws, p.best, c.cols AS nc, c.rws AS nr,
          abs(CAST(CAST(width AS FLOAT) / CAST(height AS FLOAT) AS FLOAT)
              - CAST(CAST(c.cols AS FLOAT) / CAST(c.rws AS FLOAT) AS FLOAT)) AS err,
          err < best OR (abs(err - best) < CAST(0.0001 AS FLOAT) AND nc * nr > p.cols * p.rws
            AND CAST(width AS FLOAT) * CAST(height AS FLOAT) > CAST(0.5 AS FLOAT) * CAST(nc * nr * 589824 AS FLOAT)) AS win
        FROM play p JOIN cand c ON c.k = p.k + 1)),
grid AS (SELECT width, height, cols, rws FROM play WHERE k = {len(G.GRIDS)})"""


def best_grid(spark: SparkSession, sf: str) -> DataFrame:
    return G.with_best_grid(_dims(spark, sf), "width", "height").select(*KEYS, "grid.cols", "grid.rows")


BEST_GRID_SQL = f"""WITH RECURSIVE {_GRID} SELECT {_KEYS}, cols, rws AS "rows" FROM d JOIN grid USING (width, height)"""


def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of each page with their place on its combined canvas."""
    grid = G.with_best_grid(_dims(spark, sf), "width", "height").withColumnRenamed("grid", "g")
    canvas = grid.withColumn("c", G.combined_size(F.col("g")))
    tiles = canvas.select(*KEYS, F.col("c.width").alias("canvas_width"), F.col("c.height").alias("canvas_height"),
                          F.explode_outer(G.tile_rects(F.col("g"))).alias("t"))
    return tiles.select(*KEYS, "canvas_width", "canvas_height", "t.*")


TILE_GRID_SQL = f"""WITH RECURSIVE {_GRID}, cells AS (SELECT width, height, cols, rws,
  CAST(unnest(range(cols * rws)) AS INT) AS k FROM grid),
c AS (SELECT *, greatest(1024, cols * 768) AS cw, k // cols AS "row", k % cols AS col FROM cells)
SELECT {_KEYS}, cw AS canvas_width, 1024 + rws * 768 AS canvas_height, "row", col, col * 768 AS src_x,
"row" * 768 AS src_y, (cw - cols * 768) // 2 + col * 768 AS dst_x, 1024 + "row" * 768 AS dst_y
FROM d JOIN c USING (width, height)"""

QUERIES = {
    "target_size": (target_size, TARGET_SQL),
    "rotated_size": (rotated_size, ROTATED_SQL),
    "crop_rect": (crop_rect, CROP_SQL),
    "letterbox": (letterbox, LETTERBOX_SQL),
    "best_grid": (best_grid, BEST_GRID_SQL),
    "tile_grid": (tile_grid, TILE_GRID_SQL),
}
