"""Readers and writers of segments, projects and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.plans.stages import path_exists


def segments_from(df: DataFrame, geometry: str = "geom", key: str | None = None, name: str | None = None, format: str = "lines") -> DataFrame:
    """``fid, name, geom`` with one row per single line.

    ``format``: ``lines`` (array of points), ``multi`` (array of lines), ``wkt``, ``wkb`` or
    ``points`` (array of [x, y] arrays).  With a ``key`` parts of a row get
    key * 1000 + part when there are several; otherwise ids are hashes of the line.
    """
    g = F.col(geometry)
    parts = {"lines": F.array(g), "multi": g, "wkt": G.parse_wkt_lines(g), "wkb": G.parse_wkb_lines()(g) if format == "wkb" else g, "points": F.array(F.transform(g, lambda p: G.point(F.element_at(p, 1), F.element_at(p, 2))))}[format]
    label = F.col(name).cast("string") if name else F.lit(None).cast("string")
    id_ = F.col(key).cast("long") if key else F.lit(None).cast("long")
    # the number of parts goes along, not the parts: else every line would carry all lines of its row
    d = df.select(id_.alias("k"), label.alias("name"), parts.alias("parts")).select("k", "name", F.size("parts").alias("n"), "parts")
    d = d.select("k", "name", "n", F.posexplode("parts").alias("part", "geom")).filter("geom is not null and size(geom) > 1")
    fid = F.when(F.col("k").isNull(), F.xxhash64("geom", "name")).when(F.col("n") > 1, F.col("k") * 1000 + F.col("part")).otherwise(F.col("k"))
    return d.select(fid.alias("fid"), "name", "geom")


def read_segments(spark: SparkSession, path: str, format: str = "parquet", geometry: str = "geom", key: str | None = None, name: str | None = None) -> DataFrame:
    """Segments of a Parquet file of lines, a CSV with WKT (``csv``), or GeoJSON lines (``geojson``)."""
    if format == "parquet":
        return segments_from(spark.read.parquet(path), geometry, key, name)
    if format == "csv":
        return segments_from(spark.read.option("header", True).option("quote", '"').csv(path), geometry, key, name, "wkt")
    schema = f"geometry struct<type:string,coordinates:string>, properties map<string,string>"
    d = spark.read.schema(schema).json(path)
    one = F.when(F.col("geometry.type") == "LineString", F.array(F.from_json("geometry.coordinates", "array<array<double>>"))).otherwise(F.from_json("geometry.coordinates", "array<array<array<double>>>"))
    d = d.filter("geometry.type in ('LineString', 'MultiLineString')").select(F.transform(one, lambda line: F.transform(line, lambda p: G.point(F.element_at(p, 1), F.element_at(p, 2)))).alias("geom"), *([F.col("properties")[key].alias("k")] if key else []), *([F.col("properties")[name].alias("nm")] if name else []))
    return segments_from(d, "geom", "k" if key else None, "nm" if name else None, "multi")


def write_geojson(rows: DataFrame, path: str, geometry: str = "geom") -> None:
    """GeoJSON lines: one Feature a line."""
    props = [c for c in rows.columns if c != geometry]
    coords = F.transform(geometry, lambda p: F.array(p["x"], p["y"]))
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"), F.struct(*props).alias("properties"))
    rows.select(F.to_json(f).alias("value")).write.text(path)


def write_wkt(rows: DataFrame, path: str, geometry: str = "geom") -> None:
    """CSV with the geometry as WKT."""
    rows.withColumn(geometry, G.wkt_line(F.col(geometry))).write.option("header", True).csv(path)


def check_layer(lines: DataFrame) -> DataFrame:
    """The lines, or an error if a geometry is no line or all coordinates look like degrees."""
    b = lines.agg(F.count_if(F.size("geom") < 2).alias("bad"), F.max(F.array_max(F.transform("geom", lambda p: F.abs(p["x"])))).alias("x"), F.max(F.array_max(F.transform("geom", lambda p: F.abs(p["y"])))).alias("y"), F.count(F.lit(1)).alias("n")).first()
    if b["bad"]:
        raise ValueError(f"{b['bad']} geometries are no lines")
    if b["n"] and b["x"] <= 180 and b["y"] <= 90:
        raise ValueError("coordinates look like degrees; projected metres are needed")
    return lines


def read_polygons(spark: SparkSession, path: str, key: str = "pid", geometry: str = "ring", srid: int = 0) -> DataFrame:
    """``pid, ring, rings, srid`` of a Parquet file of polygons: single rings, lists of rings, or POLYGON and MULTIPOLYGON text.

    ``rings`` holds outer rings, holes and further parts, turned so that the inside is on
    the left; ``ring`` is the first.  Rings are closed if they are not.
    """
    d = spark.read.parquet(path)

    def closed(r):
        return F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.array(F.element_at(r, 1))))

    kind = d.schema[geometry].dataType.simpleString()
    given = G.parse_wkt_polygon(geometry) if kind == "string" else F.array(F.col(geometry)) if not kind.startswith("array<array") else F.col(geometry)
    rings = G.oriented(F.transform(given, closed))
    return d.select(F.col(key).cast("long").alias("pid"), rings.alias("rings"), F.lit(srid).alias("srid")).select("pid", F.element_at("rings", 1).alias("ring"), "rings", "srid")


#: Tables of a project folder.
TABLES = ("vertices", "edges", "places", "place_vtx", "place_edges", "ways", "way_places", "way_angles", "line_graph", "edge_graph")


def save_project(path: str, tables: dict[str, DataFrame], **parameters) -> None:
    """Write tables as Parquet and the run's parameters as a one-row JSON manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    write_manifest(spark, path, **parameters)


def write_manifest(spark: SparkSession, path: str, **parameters) -> None:
    """Parameters of a run as one JSON row."""
    d = spark.range(1).select(*[F.lit(str(v)).alias(k) for k, v in parameters.items()] or [F.lit("").alias("none")])
    d.write.mode("overwrite").json(f"{path}/manifest")


def load_project(spark: SparkSession, path: str, suffix: str = "") -> dict[str, DataFrame]:
    """Tables of a project folder by name, with a suffix on the names if given."""
    return {name + suffix: spark.read.parquet(f"{path}/{name}") for name in TABLES if path_exists(spark, f"{path}/{name}")}


def import_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges with id, name, length, degree, way, acces and geometry; places) of another project."""
    p = load_project(spark, path)
    e = p["place_edges"]
    own = [c for c in ("fid", "name", "length", "degree", "way", "acces", "geom") if c in e.columns]
    return e.select(*own), p["places"]


def read_edge_list(spark: SparkSession, path: str, delimiter: str | None = None, comments: str = "#", data: list[tuple[str, str]] = ()) -> DataFrame:
    """``src, dst`` and typed ``data`` columns of delimited text; comments and blank lines go; nodes are strings."""
    sep = r"\s+" if delimiter is None else "\\Q" + delimiter + "\\E"
    line = F.trim(F.element_at(F.split("value", "\\Q" + comments + "\\E"), 1))
    p = spark.read.text(path).select(line.alias("v")).filter("v <> ''").select(F.split("v", sep).alias("p")).filter("size(p) > 1")
    more = [F.get("p", F.lit(i + 2)).cast(t).alias(n) for i, (n, t) in enumerate(data)]
    return p.select(F.element_at("p", 1).alias("src"), F.element_at("p", 2).alias("dst"), *more)


def write_edge_list(edges: DataFrame, path: str, delimiter: str = " ", data: bool = True) -> None:
    """Delimited text with ``src, dst`` and, if asked, all other columns."""
    cols = ["src", "dst", *[c for c in edges.columns if data and c not in ("src", "dst")]]
    edges.select(F.concat_ws(delimiter, *[F.col(c).cast("string") for c in cols]).alias("value")).write.text(path)


def read_adjacency_list(spark: SparkSession, path: str, delimiter: str | None = None, comments: str = "#") -> DataFrame:
    """``src, dst`` of lines with a node and its neighbours."""
    sep = r"\s+" if delimiter is None else "\\Q" + delimiter + "\\E"
    line = F.trim(F.element_at(F.split("value", "\\Q" + comments + "\\E"), 1))
    p = spark.read.text(path).select(line.alias("v")).filter("v <> ''").select(F.split("v", sep).alias("p"))
    return p.select(F.element_at("p", 1).alias("src"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("dst"))


def write_adjacency_list(edges: DataFrame, path: str, delimiter: str = " ") -> None:
    """One line per node with the targets of its edges."""
    g = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.col("dst").cast("string"))).alias("n"))
    g.select(F.concat_ws(delimiter, F.col("src").cast("string"), F.concat_ws(delimiter, "n")).alias("value")).write.text(path)


def node_link(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``kind, json`` rows: a record for every node and link."""
    n = vertices.select(F.lit("node").alias("kind"), F.to_json(F.struct(*vertices.columns)).alias("json"))
    more = [c for c in edges.columns if c not in ("src", "dst")]
    return n.unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *more)).alias("json")))


def from_node_link(rows: DataFrame, node: str = "id long", link: str = "source long, target long") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of node_link rows."""
    v = rows.filter("kind = 'node'").select(F.from_json("json", node).alias("s")).select("s.*")
    e = rows.filter("kind = 'link'").select(F.from_json("json", link).alias("s")).select("s.*")
    return v, e.withColumnRenamed("source", "src").withColumnRenamed("target", "dst")


def adjacency_json(edges: DataFrame) -> DataFrame:
    """``json`` with a node and its outgoing links."""
    more = [c for c in edges.columns if c != "src"]
    g = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*more))).alias("adjacency"))
    return g.select(F.to_json(F.struct("id", "adjacency")).alias("json"))


def from_adjacency_json(rows: DataFrame, link: str = "dst long") -> DataFrame:
    """Edges of adjacency_json rows."""
    d = rows.select(F.from_json("json", f"id long, adjacency array<struct<{','.join(x.strip().replace(' ', ':') for x in link.split(','))}>>").alias("s"))
    return d.select(F.col("s.id").alias("src"), F.explode("s.adjacency").alias("a")).select("src", "a.*")
