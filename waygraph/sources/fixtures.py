"""Networks and graphs derived from the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.functions import geom as G
from waygraph.plans.stages import table


def lattice_key(p) -> F.Column:
    """The lattice vertex of a point."""
    return (F.floor(p["x"] / 100) + 30 * F.floor(p["y"] / 100)).cast("long")


def _xy(v):
    return 100 * (v % 30) + (v * 37) % 11, 100 * F.floor(v / 30) + (v * 53) % 13


def _pairs(spark: SparkSession, sf_dir: str, without: str | None = None) -> DataFrame:
    """``v, w``: lattice vertices that a street joins; a state of the network leaves out the orders of a status."""
    orders = table(spark, sf_dir, "orders")
    if without is not None:
        orders = orders.filter(F.col("o_orderstatus") != without)
    orders = orders.select(F.col("o_custkey").alias("v"), (F.col("o_orderkey") % 8).alias("dir")).distinct()
    d = F.col("dir")
    w = F.col("v") + F.when(d < 3, 1).when(d < 6, 30).when(d == 6, 31).otherwise(29)
    e = orders.filter((d < 6) | (F.col("v") % 4 == 0)).select("v", w.alias("w"))
    top = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("top"))
    e = e.crossJoin(top).filter((F.col("w") <= F.col("top")) & (F.abs(F.col("w") % 30 - F.col("v") % 30) <= 1)).select("v", "w").distinct()
    return e


#: Statuses whose orders are missing in the first and in the second state of the network.
MISSING = ("F", "O")


def state_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The streets ``v, w`` of two states of the network."""
    return tuple(_pairs(spark, sf_dir, x) for x in MISSING)


def _line() -> F.Column:
    """The street between two lattice vertices, with a bend."""
    (x1, y1), (x2, y2) = _xy(F.col("v")), _xy(F.col("w"))
    mid = G.point((x1 + x2) / 2 + (F.col("v") * 7 + F.col("w") * 3) % 5, (y1 + y2) / 2)
    return F.array(G.point(x1, y1), mid, G.point(x2, y2))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fid, name, geom``: a street lattice, one segment per customer and kind of order."""
    e = _pairs(spark, sf_dir)
    step, row, col = F.col("w") - F.col("v"), F.floor(F.col("v") / 30), F.col("v") % 30
    name = F.when(step == 1, F.concat(F.lit("E"), row)).when(step == 30, F.concat(F.lit("N"), col)).when(step == 31, F.concat(F.lit("D"), row - col)).otherwise(F.concat(F.lit("A"), row + col))
    return e.select((F.col("v") * 100 + step).cast("long").alias("fid"), name.alias("name"), _line().alias("geom"))


#: The same segments for DuckDB: fid, v, w, name, coordinates, length.
SEGMENTS_SQL = """
p AS (SELECT DISTINCT o_custkey AS v, o_orderkey % 8 AS dir FROM orders),
e0 AS (SELECT v, CASE WHEN dir < 3 THEN v+1 WHEN dir < 6 THEN v+30 WHEN dir = 6 THEN v+31 ELSE v+29 END AS w FROM p WHERE dir < 6 OR v % 4 = 0),
e1 AS (SELECT DISTINCT v, w FROM e0 WHERE w <= (SELECT max(c_custkey) FROM customer) AND abs(w % 30 - v % 30) <= 1),
e2 AS (SELECT v, w, v*100 + (w - v) AS fid,
  CASE w - v WHEN 1 THEN 'E' || (v // 30) WHEN 30 THEN 'N' || (v % 30) WHEN 31 THEN 'D' || (v // 30 - v % 30) ELSE 'A' || (v // 30 + v % 30) END AS name,
  (100*(v % 30) + (v*37) % 11)::DOUBLE AS x1, (100*(v // 30) + (v*53) % 13)::DOUBLE AS y1,
  (100*(w % 30) + (w*37) % 11)::DOUBLE AS x2, (100*(w // 30) + (w*53) % 13)::DOUBLE AS y2 FROM e1),
seg AS (SELECT *, (x1+x2)/2 + (v*7 + w*3) % 5 AS mx, (y1+y2)/2 AS my,
  sqrt(((x1+x2)/2 + (v*7+w*3)%5 - x1)*((x1+x2)/2 + (v*7+w*3)%5 - x1) + ((y1+y2)/2-y1)*((y1+y2)/2-y1))
  + sqrt((x2-((x1+x2)/2 + (v*7+w*3)%5))*(x2-((x1+x2)/2 + (v*7+w*3)%5)) + (y2-(y1+y2)/2)*(y2-(y1+y2)/2)) AS length FROM e2)
"""


def _state_sql(name: str, without: str) -> str:
    return f"""{name} AS (SELECT DISTINCT v, CASE WHEN dir < 3 THEN v+1 WHEN dir < 6 THEN v+30 WHEN dir = 6 THEN v+31 ELSE v+29 END AS w FROM (SELECT DISTINCT o_custkey AS v, o_orderkey % 8 AS dir FROM orders WHERE o_orderstatus <> '{without}') WHERE dir < 6 OR v % 4 = 0)"""


#: The two states for DuckDB: sa and sb, rows of seg.
STATES_SQL = _state_sql("oa", MISSING[0]) + ", " + _state_sql("ob", MISSING[1]) + ", sa AS (SELECT seg.* FROM seg JOIN oa USING (v, w)), sb AS (SELECT seg.* FROM seg JOIN ob USING (v, w))"


def supplier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite ``src`` (supplier), ``dst`` (part)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def customer_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite ``src`` (customer), ``dst`` (supplier, shifted above all customers)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst")).distinct()


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted digraph ``src, dst, w`` of consecutive event types of a user."""
    e = table(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_type").alias("src"), nxt.alias("dst")).filter("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def street_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice as ``src, dst, w``: vertices and integer metres."""
    e = _pairs(spark, sf_dir)
    return e.select(F.col("v").alias("src"), F.col("w").alias("dst"), G.length(_line()).cast("int").alias("w"))
