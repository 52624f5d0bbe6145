"""Queries over grids and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import grid
from tessella.plans.registry import events, query

KERNEL = ((1, 4, 6, 4, 1), (4, 16, 24, 16, 4), (6, 24, 36, 24, 6), (4, 16, 24, 16, 4), (1, 4, 6, 4, 1))
_GRID = "SELECT event_id // 50 AS r, event_id % 50 AS c, CASE WHEN event_id // 50 IN (0, (SELECT max(event_id) // 50 FROM events)) OR event_id % 50 IN (0, 49) THEN 100.0 ELSE 10.0 + value END::DOUBLE AS v FROM events"


def pilot(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """50 cells a row and a cell an event, a hot border around them; with the number of rows."""
    rows = events(spark, d).agg(F.max("idx")).first()[0] // 50 + 1
    r, c = F.expr("idx div 50"), F.col("idx") % 50
    border = r.isin(0, rows - 1) | c.isin(0, 49)
    return events(spark, d).select(r.alias("r"), c.alias("c"), F.when(border, 100.0).otherwise(10.0 + F.col("value")).alias("v")), rows


def _step(source: str) -> str:
    return f"""SELECT r, c, CASE WHEN r IN (0, (SELECT max(event_id) // 50 FROM events)) OR c IN (0, 49) THEN v ELSE 0.5 * v + 0.125 * n + 0.125 * s + 0.125 * w + 0.125 * e END AS v FROM (
      SELECT r, c, v, lag(v) OVER (PARTITION BY c ORDER BY r) AS n, lead(v) OVER (PARTITION BY c ORDER BY r) AS s, lag(v) OVER (PARTITION BY r ORDER BY c) AS w, lead(v) OVER (PARTITION BY r ORDER BY c) AS e FROM {source})"""


def _heat(steps: int) -> str:
    return f"WITH g0 AS ({_GRID})" + "".join(f", g{k} AS MATERIALIZED ({_step(f'g{k - 1}')})" for k in range(1, steps + 1)) + f" SELECT * FROM g{steps}"


@query("stencil_step", _heat(1))
def _(spark: SparkSession, d: str) -> DataFrame:
    cells, rows = pilot(spark, d)
    return grid.stencil_2d(cells, rows, 50)


@query("heat_diffusion", _heat(6))
def _(spark: SparkSession, d: str) -> DataFrame:
    cells, rows = pilot(spark, d)
    return grid.heat(cells, rows, 50, 6)


_IMAGE = "SELECT event_id // 50 AS r, event_id % 50 AS c, CAST(floor(value) AS INT) % 256 AS v FROM events"


def _image(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.expr("idx div 50").alias("r"), (F.col("idx") % 50).alias("c"), (F.floor("value").cast("int") % 256).alias("v"))


@query("conv5x5", f"""WITH img AS ({_IMAGE}), k AS (SELECT i, j, [[1,4,6,4,1],[4,16,24,16,4],[6,24,36,24,6],[4,16,24,16,4],[1,4,6,4,1]][i + 1][j + 1]::DOUBLE AS w FROM range(0, 5) a(i), range(0, 5) b(j))
SELECT r - (i - 2) AS r, c - (j - 2) AS c, sum(w * v) / 256 AS v FROM img, k WHERE r - (i - 2) BETWEEN 0 AND (SELECT max(r) FROM img) AND c - (j - 2) BETWEEN 0 AND 49 GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return grid.convolve(_image(spark, d), KERNEL, 1 / 256)


_NEAR = """SELECT *, lag(v) OVER r AS w, lead(v) OVER r AS e, lag(v) OVER c AS n, lead(v) OVER c AS s FROM img WINDOW r AS (PARTITION BY r ORDER BY c), c AS (PARTITION BY c ORDER BY r)"""


@query("sobel", f"""WITH img AS ({_IMAGE}), p AS (SELECT a.r, a.c,
  max(b.v) FILTER (WHERE b.r = a.r - 1 AND b.c = a.c - 1) AS nw, max(b.v) FILTER (WHERE b.r = a.r - 1 AND b.c = a.c) AS n, max(b.v) FILTER (WHERE b.r = a.r - 1 AND b.c = a.c + 1) AS ne,
  max(b.v) FILTER (WHERE b.r = a.r AND b.c = a.c - 1) AS w, max(b.v) FILTER (WHERE b.r = a.r AND b.c = a.c + 1) AS e,
  max(b.v) FILTER (WHERE b.r = a.r + 1 AND b.c = a.c - 1) AS sw, max(b.v) FILTER (WHERE b.r = a.r + 1 AND b.c = a.c) AS s, max(b.v) FILTER (WHERE b.r = a.r + 1 AND b.c = a.c + 1) AS se
  FROM img a JOIN img b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c),
g AS (SELECT r, c, (ne + 2 * e + se) - (nw + 2 * w + sw) AS gx, (sw + 2 * s + se) - (nw + 2 * n + ne) AS gy FROM p)
SELECT r, c, CASE WHEN gx IS NULL OR gy IS NULL THEN 0.0 ELSE sqrt(gx::DOUBLE * gx + gy::DOUBLE * gy) END AS magnitude FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    image = _image(spark, d)
    rows = image.agg(F.max("r")).first()[0] + 1
    return grid.sobel(image, rows, 50)


@query("sliding_history", """WITH w AS (SELECT event_id AS idx, user_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 10 PRECEDING)) AS xs FROM events),
m AS (SELECT *, xs[len(xs) // 2 + 1] AS median FROM w)
SELECT idx, user_id, median, list_sort(list_transform(xs, lambda x: abs(x - median)))[len(xs) // 2 + 1] AS mad FROM m""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return grid.sliding_history(events(spark, d), "user_id", "idx", "value", 11).select("idx", "user_id", "median", "mad")
