"""Queries of the whole workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import elementwise, grid, kernels
from tessella.plans.joins import _BOXES, boxes
from tessella.plans.registry import events, query, table
from tessella.plans.statistics import micro, micro_sql


@query("integration", f"SELECT {micro_sql('sum(exp(-0.1 * x) * sin(x) * 0.00001)', 'value')}, {micro_sql('(exp(-10.0::DOUBLE) * (-0.1 * sin(100.0::DOUBLE) - cos(100.0::DOUBLE)) + 1) / 1.01', 'exact')} FROM (SELECT (i + 0.5) * 0.00001::DOUBLE AS x FROM range(0, 10000000) t(i))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return kernels.integrate(spark, 10_000_000).select(micro("value"), micro("exact"))


_PARTICLE = "SELECT event_id AS idx, value / 10 AS x, user_id / 5.0 AS y, (event_id % 60) / 2.0 - 15 AS z, 0.5 + (event_id % 1024) / 1024.0 AS mass, CAST(16 + (event_id * 37) % 496 AS INT) AS work FROM events"


@query("particles", f"""WITH p AS ({_PARTICLE}), t AS (SELECT p.*, k, 0.000031::DOUBLE * (idx + 1) + 0.013::DOUBLE * k AS phase FROM p, range(1, 512) r(k) WHERE k <= work),
u AS (SELECT idx, mass, phase, (x + sin(phase) * 3) ** 2 + (y + cos(phase * 1.37) * 2) ** 2 + (z + sin(phase * 0.73) * 1.5) ** 2 + 1 AS r2 FROM t) SELECT idx, CAST(floor(sum(mass * (sin(r2 * 0.001) + cos(phase)) / sqrt(r2)) * 1e4 + 0.5) AS BIGINT) AS energy FROM u GROUP BY idx""")
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("idx")
    rows = events(spark, d).select("idx", (F.col("value") / 10).alias("x"), (F.col("user_id") / 5.0).alias("y"), ((i % 60) / 2.0 - 15).alias("z"), (0.5 + (i % 1024) / 1024.0).alias("mass"), (16 + (i * 37) % 496).cast("int").alias("work"))
    return kernels.particle_energy(rows).select("idx", F.floor(F.col("energy") * 1e4 + 0.5).cast("long").alias("energy"))


@query("mandelbrot", """WITH p AS (SELECT event_id AS id, (event_id % 64) / 64.0::DOUBLE * 3.2 - 2.2 AS x, (event_id // 64 % 64) / 64.0::DOUBLE * 2.4 - 1.2 AS y FROM events)
SELECT id, list_reduce(list_prepend({r: 0.0::DOUBLE, i: 0.0::DOUBLE, n: 0}, list_transform(range(0, 48), lambda k: {r: x, i: y, n: 0})), lambda z, c: CASE WHEN z.r * z.r + z.i * z.i <= 4.0 THEN {r: z.r * z.r - z.i * z.i + c.r, i: 2.0::DOUBLE * z.r * z.i + c.i, n: z.n + 1} ELSE z END).n AS n FROM p""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """As many points as there are events, on tiles of 64 x 64."""
    i = F.col("idx")
    rows = events(spark, d).select(i.alias("id"), ((i % 64) / 64.0 * 3.2 - 2.2).alias("x"), ((F.expr("idx div 64") % 64) / 64.0 * 2.4 - 1.2).alias("y"))
    return kernels.escape_times(rows, 48).select("id", "n")


def _px(x: str, y: str) -> str:
    return f"((({x}) * 73 + ({y}) * 151 + frame * 31 + ({x}) * ({y}) * 7) % 256)"


_CORNERS = ", ".join(_px(f"x + {a}", f"y + {b}") for a in ("0", "size - 1") for b in ("0", "size - 1"))


@query("quadtree", f"""WITH RECURSIVE q AS (SELECT c_custkey // 64 AS frame, (c_custkey % 8) * 32 AS x, (c_custkey % 64 // 8) * 32 AS y, 32::BIGINT AS size, 0 AS level FROM customer
  UNION ALL SELECT frame, x + a * (size // 2), y + b * (size // 2), size // 2, level + 1 FROM q, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) t(a, b) WHERE level < 4 AND size > 2 AND greatest({_CORNERS}) - least({_CORNERS}) > 54)
SELECT frame, level, count(*) AS nodes, sum(x * size + y)::BIGINT AS places, sum(greatest({_CORNERS}) - least({_CORNERS}))::BIGINT AS contrast FROM q GROUP BY frame, level""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """64 cells of 32 pixels a frame, and a cell for each customer; all nodes, summed up by level."""
    cell = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("idx")).select(F.expr("idx div 64").alias("frame"), (F.col("idx") % 8 * 32).alias("x"), (F.expr("idx % 64 div 8") * 32).alias("y"), F.lit(32).cast("long").alias("size"))
    nodes = kernels.quadtree(cell, 4)
    return nodes.groupBy("frame", "level").agg(F.count("*").alias("nodes"), F.sum(F.col("x") * F.col("size") + F.col("y")).alias("places"), F.sum("contrast").alias("contrast"))


@query("monte_carlo", "WITH p AS (SELECT event_id AS idx, (event_id * 7919 + s * 104729) % 65536 - 32768 AS x, (event_id * 6007 + s * 15485863) % 65536 - 32768 AS y FROM events, range(0, 96) b(s)) SELECT idx, count(*) FILTER (WHERE x * x + y * y < 32768 * 32768) AS hits FROM p GROUP BY idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    return kernels.circle_hits(events(spark, d).select("idx"), 96)


_AROUND = [_px(f"x + {a}", f"y + {b}") for a in range(7) for b in range(7)]


@query("morphology", f"SELECT frame, x, y, least({', '.join(_AROUND)})::BIGINT AS low, greatest({', '.join(_AROUND)})::BIGINT AS high FROM (SELECT event_id // 1024 AS frame, event_id % 32 AS x, (event_id // 32) % 32 AS y FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return kernels.morphology(events(spark, d).select(F.expr("idx div 1024").alias("frame"), (F.col("idx") % 32).alias("x"), (F.expr("idx div 32") % 32).alias("y")))


@query("mixed_kernels", """WITH p AS (SELECT event_id AS idx, event_id % 4 AS mode, k, ((event_id + k) * 73 + (event_id * 3 + k * 3) * 151 + (event_id % 4) * 31 + (event_id + k) * (event_id * 3 + k * 3) * 7) % 256 AS px FROM events, range(0, 25) b(k)),
c AS (SELECT *, abs((px > 127)::INT - lag((px > 127)::INT) OVER (PARTITION BY idx ORDER BY k)) AS turn FROM p)
SELECT idx, mode, (CASE mode WHEN 0 THEN sum(px) WHEN 1 THEN min(px) WHEN 2 THEN max(px) ELSE sum(turn) END)::BIGINT AS n FROM c GROUP BY idx, mode""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return kernels.mixed_kernels(events(spark, d).select("idx"))


_IMAGE = "SELECT event_id // 64 AS r, event_id % 64 AS c, ((event_id % 64) * 73 + (event_id // 64) * 151 + 3 * 31 + (event_id % 64) * (event_id // 64) * 7) % 256 AS v FROM events"
#: A cell's value or, outside the image, 0.
_AT = lambda dr, dc: f"coalesce(max(b.v) FILTER (WHERE b.r = a.r + {dr} AND b.c = a.c + {dc}), 0)"
_BLUR = " + ".join(f"{w} * {_AT(i - 1, j - 1)}" for i, row in enumerate(((1, 2, 1), (2, 4, 2), (1, 2, 1))) for j, w in enumerate(row))
_SIDE = lambda dr, dc: f"max(b.v) FILTER (WHERE b.r = a.r + {dr} AND b.c = a.c + {dc})"


@query("multistage_pipeline", f"""WITH img AS ({_IMAGE}), blur AS (SELECT a.r, a.c, ({_BLUR}) / 16 AS v FROM img a JOIN img b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c),
g AS (SELECT a.r, a.c, ({_SIDE(-1, 1)} + 2 * {_SIDE(0, 1)} + {_SIDE(1, 1)}) - ({_SIDE(-1, -1)} + 2 * {_SIDE(0, -1)} + {_SIDE(1, -1)}) AS gx, ({_SIDE(1, -1)} + 2 * {_SIDE(1, 0)} + {_SIDE(1, 1)}) - ({_SIDE(-1, -1)} + 2 * {_SIDE(-1, 0)} + {_SIDE(-1, 1)}) AS gy
  FROM blur a JOIN blur b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c)
SELECT r, c, (CASE WHEN r > 0 AND c BETWEEN 1 AND 62 AND r < (SELECT max(r) FROM img) AND sqrt(gx * gx + gy * gy) > 320 THEN 255 ELSE 0 END)::INT AS edge FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Blur, gradient and threshold of a procedural image of one pixel an event, one after the other."""
    at = F.expr("idx div 64")
    image = events(spark, d).select(at.alias("r"), (F.col("idx") % 64).alias("c"), kernels.pixel(F.col("idx") % 64, at, F.lit(3)).cast("double").alias("v"))
    rows = image.agg(F.max("r")).first()[0] + 1
    blurred = grid.convolve(image, ((1, 2, 1), (2, 4, 2), (1, 2, 1)), 1 / 16)
    edges = grid.sobel(blurred, rows, 64)
    return edges.select("r", "c", F.when(F.col("magnitude") > 320, 255).otherwise(0).alias("edge"))


@query("image_batches", "WITH i AS (SELECT event_id // 500 AS batch, CAST(floor(value) AS INT) % 256 AS px FROM events) SELECT batch, count(*) AS n, sum(CASE WHEN px > 100 THEN 255 ELSE 0 END)::BIGINT AS lit, min(px) AS least, max(px) AS most FROM i GROUP BY batch")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select(F.expr("idx div 500").alias("batch"), (F.floor("value").cast("int") % 256).alias("px"))
    marked = rows.withColumn("on", elementwise.threshold(F.col("px"), 100))
    return marked.groupBy("batch").agg(F.count("*").alias("n"), F.sum("on").alias("lit"), F.min("px").alias("least"), F.max("px").alias("most"))


@query("batch_compression", "SELECT page_id, strlen(html)::BIGINT AS n_bytes, strlen(html) > 200 AS smaller, true AS same FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return kernels.compress(table(spark, d, "pages"), "page_id", "html").select("page_id", "n_bytes", (F.col("packed_bytes") < F.col("n_bytes")).alias("smaller"), "same")


def _bvh_sql(levels: int) -> str:
    text = f"WITH l0 AS (SELECT *, 1::BIGINT AS node, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy, (min_z + max_z) / 2 AS cz FROM ({_BOXES}))"
    for k in range(1, levels):
        text += f""", s{k} AS (SELECT node, max(cx) - min(cx) AS wx, max(cy) - min(cy) AS wy, max(cz) - min(cz) AS wz FROM l{k - 1} GROUP BY node),
        l{k} AS (SELECT id, min_x, max_x, min_y, max_y, min_z, max_z, node * 2 + ntile(2) OVER (PARTITION BY node ORDER BY pos, id) - 1 AS node, cx, cy, cz FROM (SELECT b.*, CASE WHEN wx = greatest(wx, wy, wz) THEN cx WHEN wy = greatest(wx, wy, wz) THEN cy ELSE cz END AS pos FROM l{k - 1} b JOIN s{k} USING (node)))"""
    bounds = "count(*) AS n, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y, min(min_z) AS min_z, max(max_z) AS max_z"
    return text + " UNION ALL ".join(f" SELECT {k}::INT AS level, node, {bounds} FROM l{k} GROUP BY node" for k in range(levels))


@query("bounding_tree", _bvh_sql(4))
def _(spark: SparkSession, d: str) -> DataFrame:
    return kernels.bounding_tree(boxes(spark, d), 4)


_START = "SELECT event_id AS id, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS x, (event_id * 104729 % 10009) / 10009.0::DOUBLE AS y, (event_id % 7 - 3) / 10000.0::DOUBLE AS vx, (event_id % 5 - 2) / 10000.0::DOUBLE AS vy, 0.75 + (event_id % 10) / 20.0::DOUBLE AS mass FROM events"


def _frame_sql(source: str) -> str:
    walls = lambda a: f"CASE WHEN n{a} < 0 THEN -n{a} WHEN n{a} > 1 THEN 2.0::DOUBLE - n{a} ELSE n{a} END AS {a}, CASE WHEN n{a} < 0 OR n{a} > 1 THEN -w{a} * 0.8::DOUBLE ELSE w{a} END AS v{a}"
    return f"""(WITH a AS (SELECT *, least(floor(greatest(0, least(0.999999999::DOUBLE, x)) * 200), 199) AS cx, least(floor(greatest(0, least(0.999999999::DOUBLE, y)) * 200), 199) AS cy FROM {source}),
  p AS (SELECT p.id, j, i, o.id AS oid, (o.x - p.x) / r * (0.000002::DOUBLE * o.mass / r / r) AS fx, (o.y - p.y) / r * (0.000002::DOUBLE * o.mass / r / r) AS fy FROM (SELECT p.id, p.x, p.y, i, j, p.cx + i AS cx, p.cy + j AS cy FROM a p, (VALUES (-1), (0), (1)) s(i), (VALUES (-1), (0), (1)) t(j)) p JOIN a o ON p.cx = o.cx AND p.cy = o.cy AND p.id <> o.id, LATERAL (SELECT sqrt((o.x - p.x) ** 2 + (o.y - p.y) ** 2 + 1e-6) AS r)),
  f AS (SELECT id, sum(fx) AS fx, sum(fy) AS fy FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY j, i, oid) AS k FROM p) WHERE k <= 96 GROUP BY id),
  m AS (SELECT a.id, mass, x + (vx + coalesce(fx, 0)) * 0.9995::DOUBLE AS nx, y + (vy + coalesce(fy, 0)) * 0.9995::DOUBLE AS ny, (vx + coalesce(fx, 0)) * 0.9995::DOUBLE AS wx, (vy + coalesce(fy, 0)) * 0.9995::DOUBLE AS wy FROM a LEFT JOIN f USING (id))
  SELECT id, mass, {walls('x')}, {walls('y')} FROM m)"""


@query("particle_simulation", f"SELECT id, {', '.join(micro_sql(c, c) for c in ('x', 'y', 'vx', 'vy'))} FROM {_frame_sql(_frame_sql(f'({_START})'))}")
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("idx")
    rows = events(spark, d).select(i.alias("id"), ((i * 7919 % 10007) / 10007.0).alias("x"), ((i * 104729 % 10009) / 10009.0).alias("y"), ((i % 7 - 3) / 10000.0).alias("vx"), ((i % 5 - 2) / 10000.0).alias("vy"), (0.75 + (i % 10) / 20.0).alias("mass"))
    return kernels.simulate(rows, 200, 2).select("id", *[micro(c) for c in ("x", "y", "vx", "vy")])
