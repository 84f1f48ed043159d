"""Layers in and out: tables of lines, polylines, points and regions, their attributes, and results joined back to them.

lines: line_id, x1, y1, x2, y2; polylines: base_id, coords; points: pt_id, x, y; regions: region_id, ring; polygons: region_id, rings;
coords and ring are array<struct<x: double, y: double>>, rings is an array of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbangraph.functions import geometry as G

POINTS = "array<struct<x:double,y:double>>"


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Parquet, CSV, JSON or ORC through Spark's readers."""
    return spark.read.format(kind).options(**options).load(path)


def from_wkt(wkt: Column) -> Column:
    """The points of a WKT point, line string or polygon's outer ring."""
    outer = F.regexp_extract(wkt, r"\(+([^()]*)\)", 1)
    pairs = F.transform(F.split(F.trim(outer), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y")))


def rings_from_wkt(wkt: Column) -> Column:
    """The rings of a WKT polygon, its outline first, then its holes; a multipolygon may have one part only, more are an error."""
    parts = F.regexp_count(wkt, F.lit(r"\(\s*\(\s*[^\s()]"))
    whole = F.when(parts > 1, F.raise_error(F.concat(F.lit("a polygon has more than one part: "), F.left(wkt, F.lit(60))))).otherwise(wkt)
    pairs = F.transform(F.regexp_extract_all(whole, F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+")))
    point = lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y"))
    return F.transform(pairs, lambda ring: F.transform(ring, point))


def rings_from_geojson(json: Column) -> Column:
    """The rings of a GeoJSON Polygon, or of a MultiPolygon of one part; more parts are an error."""
    single = F.from_json(json, "struct<coordinates:array<array<array<double>>>>")["coordinates"]
    several = F.from_json(json, "struct<coordinates:array<array<array<array<double>>>>>")["coordinates"]
    checked = F.when(F.size(several) > 1, F.raise_error(F.lit("a polygon has more than one part"))).otherwise(F.get(several, F.lit(0)))
    rings = F.when(F.get_json_object(json, "$.type") == "MultiPolygon", checked).otherwise(single)
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


def from_geojson(json: Column) -> Column:
    """The points of a GeoJSON LineString, or of a Polygon's outer ring."""
    line = F.from_json(json, "struct<coordinates:array<array<double>>>")["coordinates"]
    ring = F.get(F.from_json(json, "struct<coordinates:array<array<array<double>>>>")["coordinates"], F.lit(0))
    pairs = F.when(F.get_json_object(json, "$.type") == "Polygon", ring).otherwise(line)
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def to_wkt(coords: Column, kind: str = "LINESTRING") -> Column:
    inner = F.array_join(F.transform(coords, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.concat(F.lit(f"{kind} (("), inner, F.lit("))")) if kind == "POLYGON" else F.concat(F.lit(f"{kind} ("), inner, F.lit(")"))


def lines(layer: DataFrame, coords: str = "coords", row_id: str = "line_id") -> DataFrame:
    """Lines of exactly two points; those with fewer are skipped, more are an error."""
    n = F.size(coords)
    checked = F.when(n > 2, F.raise_error(F.concat(F.lit("a line has more than two points: "), F.col(row_id).cast("string")))).otherwise(F.col(coords))
    point = lambda i, c: F.get(checked, F.lit(i))[c].alias(f"{c}{i + 1}")
    return layer.where(n >= 2).select(F.col(row_id).alias("line_id"), point(0, "x"), point(0, "y"), point(1, "x"), point(1, "y"))


def polylines(layer: DataFrame, parts: str = "parts", row_id: str = "base_id") -> DataFrame:
    """Each part of a geometry as a polyline of its own."""
    return layer.select(F.col(row_id).alias("base_id"), F.explode(parts).alias("coords")).where(F.size("coords") >= 2)


def points(layer: DataFrame, coords: str = "coords", row_id: str = "pt_id") -> DataFrame:
    """Any geometry as its centroid."""
    x, y = G.ring_centroid(F.col(coords))
    return layer.select(F.col(row_id).alias("pt_id"), x.alias("x"), y.alias("y"))


def regions(layer: DataFrame, ring: str = "ring", row_id: str = "region_id") -> DataFrame:
    """Outer rings without the repeated first point."""
    return layer.select(F.col(row_id).alias("region_id"), opened(F.col(ring)).alias("ring"))


def opened(ring: Column) -> Column:
    """Without the repeated first point."""
    closed = F.get(ring, F.lit(0)) == F.element_at(ring, -1)
    return F.when(closed & (F.size(ring) > 1), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def polygons(layer: DataFrame, rings: str = "rings", row_id: str = "region_id") -> DataFrame:
    """region_id, rings: outlines first, then holes, without repeated first points; empty rings are left out and null stays null."""
    full = F.filter(F.col(rings), lambda r: F.size(r) > 0)
    return layer.select(F.col(row_id).alias("region_id"), F.transform(full, opened).alias("rings"))


def values(layer: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    return layer.select(row_id, *columns)


def attraction_value(columns: list[str]) -> Column:
    """The sum of the columns, nulls as 0; 1 without columns."""
    if not columns:
        return F.lit(1.0)
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return total


def described(layer: DataFrame) -> list[tuple[str, str]]:
    """(column, integer | double | string | other)."""
    kinds = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "double", "double": "double", "string": "string"}
    return [(f.name, kinds.get(f.dataType.simpleString(), "other")) for f in layer.schema]


def positive(attractions: DataFrame, value: str = "value") -> DataFrame:
    return attractions.where(F.col(value) > 0)


def with_columns(layer: DataFrame, results: DataFrame, row_id: str) -> DataFrame:
    """layer with the columns of results, which replace columns of the same name."""
    names = [c for c in results.columns if c != row_id]
    return layer.drop(*names).join(results, row_id, "left")


def created(rows: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    rows.write.format(kind).mode("overwrite").save(path)
    return rows.sparkSession.read.format(kind).schema(rows.schema).load(path)


def themed(values: DataFrame, column: str, ranges: list[tuple[float, float, str]]) -> DataFrame:
    """A category for each half-open range [low, high)."""
    category = F.lit(None).cast("string")
    for low, high, name in reversed(ranges):
        category = F.when((F.col(column) >= low) & (F.col(column) < high), name).otherwise(category)
    return values.withColumn("category", category)
