"""Analyses over several radii, weights and columns, as one wide table by line."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbangraph.functions import normalize as N
from urbangraph.functions.naming import column_name, short
from urbangraph.lineage import cut
from urbangraph.operators import axial, grouping, isovist, multidistance, paths, raster, reach, segment_map
from urbangraph.radii import Radius


def wide(lines: DataFrame, results: Iterable[DataFrame], row_id: str = "line_id") -> DataFrame:
    out = lines.select(row_id)
    for r in results:
        out = out.join(r, row_id, "left")
    return out


def reach_analysis(lines: DataFrame, radii: list[Radius], unlinks: DataFrame | None = None, area: bool = True, unit: str = "km2") -> DataFrame:
    g = axial.graph(lines, unlinks)
    scale = {"km2": 1e-6, "ha": 1e-4, "m2": 1.0}[unit]
    found = []
    for r in (s for radius in radii for s in radius.split()):
        out = reach.reach(g, r, area)
        name = lambda extra, u="", r=r: column_name("R", "", r, extra=extra, unit=u)
        found.append(out.select("line_id", F.col("reach_count").alias(name("N")), F.col("reach_length").alias(name("L")), *([(F.col("reach_area") * scale).alias(name("a", unit))] if area else [])))
    return wide(lines, found)


def network_integration_analysis(lines: DataFrame, steps: list[int | None], unlinks: DataFrame | None = None) -> DataFrame:
    g, found = axial.graph(lines, unlinks), []
    for s in steps:
        r = Radius(steps=s)
        name = column_name("I", "", r)
        out = reach.network_integration(g, r)
        found.append(out.select("line_id", F.col("integration").alias(name), F.col("node_count").alias(name + "N"), F.col("total_depth").alias(name + "T"), N.mean_depth(F.col("node_count"), F.col("total_depth")).alias(name + "M")))
    return wide(lines, found)


def junction_integration_analysis(lines: DataFrame, steps: list[int | None], unlinks: DataFrame | None = None) -> DataFrame:
    """x, y of each point where lines meet, and for each radius the mean integration of the lines there."""
    g, out = axial.graph(lines, unlinks), None
    for s in steps:
        name = column_name("I", "", Radius(steps=s))
        found = reach.junction_scores(g, reach.network_integration(g, Radius(steps=s))).withColumnRenamed("score", name)
        out = found if out is None else out.join(found, ["x", "y"])
    return out


def angular_integration_analysis(lines: DataFrame, radii: list[Radius], threshold: float = 0.0, precision: float = 1.0) -> DataFrame:
    found = []
    for r in radii:
        out = paths.angular_integration(lines, r, threshold, precision)
        n, td, l, tdl = (F.col(c) for c in ("node_count", "total_depth", "total_weight", "total_depth_weight"))
        name = lambda w="", k="", x="", r=r: column_name("AI", "", r, weight=w, normalisation=k, extra=x)
        found.append(out.select(
            "line_id", N.integration(n, td).alias(name()), N.integration_syntax(n, td).alias(name(k="A")), N.integration_hillier(n, td).alias(name(k="H")),
            N.integration_length(l, tdl).alias(name("wl")), N.integration_syntax(l, tdl).alias(name("wl", "A")), N.integration_hillier(l, tdl).alias(name("wl", "H")),
            n.alias(name(x="N")), td.alias(name(x="T")), N.mean_depth(n, td).alias(name(x="M")),
        ))
    return wide(lines, found)


def betweenness_analysis(lines: DataFrame, kinds: list[str], radii: list[Radius], weights: list[str | None] = [None]) -> DataFrame:  # noqa: B006
    found = []
    for k in kinds:
        for r in radii:
            for w in weights:
                name = column_name("B", k, r, weight="wl" if w == "length" else short(w) if w else "")
                out = paths.segment_betweenness(lines, k, r, w)
                found.append(N.standard(out, "betweenness", name + "S").select("line_id", F.col("betweenness").alias(name), name + "S", F.col("node_count").alias(name + "N"), F.col("total_depth").alias(name + "T")))
    return wide(lines, found)


def angular_betweenness_analysis(lines: DataFrame, walking: list[float | None]) -> DataFrame:
    found = []
    for w in walking:
        for by_length in (False, True):
            name = column_name("AB", "", Radius(walking=w), weight="wl" if by_length else "")
            out = paths.angular_betweenness(lines, by_length, w)
            b, n, td = (F.col(c) for c in ("betweenness", "node_count", "total_depth"))
            found.append(N.standard(out, "betweenness", name + "S").select("line_id", b.alias(name), N.choice(b, n).alias(name + "T"), name + "S", N.choice_syntax(b, td).alias(name + "C")))
    return wide(lines, found)


def angular_choice_analysis(lines: DataFrame, radii: list[Radius], threshold: float = 0.0, precision: float = 1.0) -> DataFrame:
    found = []
    for r in radii:
        for by_length in (False, True):
            name = column_name("AC", "", r, weight="wl" if by_length else "")
            out = paths.angular_choice(lines, r, by_length, threshold, precision)
            c, n, td = (F.col(x) for x in ("choice", "node_count", "total_depth"))
            found.append(N.standard(out, "choice", name + "S").select("line_id", c.alias(name), N.choice(c, n).alias(name + "T"), name + "S", N.choice_syntax(c, td).alias(name + "C"), n.alias(name + "N"), td.alias(name + "D")))
    return wide(lines, found)


def limited(kind: str, limit: float | Radius | dict[str, float | Radius] | None) -> Radius:
    """The limit of one kind of distance: a number is of that kind, a Radius as it is, and a dict has one for each kind."""
    one = limit.get(kind) if isinstance(limit, dict) else limit
    return one if isinstance(one, Radius) else Radius(**({} if one is None else {kind: one}))


def attraction_distance_analysis(
    lines: DataFrame, attractions: DataFrame, kinds: list[str], limit: float | Radius | dict[str, float | Radius] | None = None, columns: list[str] = [], targets: DataFrame | None = None, weight: str | None = None, weight_per_metre: float = 0.0  # noqa: B006
) -> DataFrame:
    """By line, or by point of targets (pt_id, x, y). attractions: points, or regions with a column ring, which are entered every 20 units along their edge. A
    column: attractions where it is positive. weight: the column of lines
    that distances by weights add up; a metre between a line and a point counts weight_per_metre."""
    g, found = axial.graph(lines), []
    if "ring" in attractions.columns:
        entries = segment_map.region_points(attractions, ENTRANCE)
        attractions = entries.join(attractions.drop("ring"), "region_id").withColumn("pt_id", F.col("region_id"))
    for column in columns or [None]:
        some = attractions if column is None else attractions.where(F.col(column) > 0)
        for k in kinds:
            radius = limited(k, limit)
            name = column_name("AD", k, radius, extra=short(column) if column else "")
            if targets is None and k in ("steps", "walking") and set(radius.limits()) <= {k}:
                found.append(reach.attraction_distance(g, some, k, radius.limits().get(k)).withColumnRenamed("distance", name))
            else:
                out = multidistance.attraction_distance(g, some, k, radius, targets, weight, weight_per_metre)
                found.append(out.withColumnsRenamed({"target": "line_id" if targets is None else "pt_id", "distance": name}))
    return wide(lines, found) if targets is None else wide(targets, found, "pt_id")


#: Between the entrances of a region.
ENTRANCE = 20.0


def attraction_reach_analysis(
    lines: DataFrame, attractions: DataFrame, kinds: list[str], limit: float | Radius | dict[str, float | Radius], columns: list[str], decay: str = "constant", constant: float = 1.0, targets: DataFrame | None = None, distribution: str = "copy"
) -> DataFrame:
    """By line, or by point of targets. attractions: points, or regions with a column ring, whose values are copied to their entrances or divided among
    them."""
    g, found, regions = axial.graph(lines), [], "ring" in attractions.columns
    for column in columns:
        valued = attractions.withColumn("value", F.coalesce(F.col(column).cast("double"), F.lit(0.0)))
        if regions:
            valued = multidistance.polygon_attractions(valued, ENTRANCE, distribution)
        for k in kinds:
            radius = limited(k, limit)
            name = column_name("AR", "", radius, decay=decay[0] if decay != "constant" else "", extra=short(column))
            if targets is None and not regions and k in ("steps", "walking") and set(radius.limits()) <= {k}:
                found.append(reach.attraction_reach(g, valued, k, radius.limits().get(k), decay, constant).withColumnRenamed("score", name))
            else:
                out = multidistance.attraction_reach(g, valued, k, radius, decay, constant, targets)
                found.append(out.withColumnsRenamed({"target": "line_id" if targets is None else "pt_id", "score": name}))
    return wide(lines, found) if targets is None else wide(targets, found, "pt_id")


def attraction_betweenness_analysis(lines: DataFrame, attractions: DataFrame, radius: Radius, column: str, kinds: tuple[str, ...] = ("angular",)) -> DataFrame:
    weights = axial.line_weights(attractions.withColumn("weight", F.col(column).cast("double")), lines)
    found = []
    for k in kinds:
        out = paths.segment_betweenness(lines.join(weights, "line_id"), k, radius, "weight")
        name = column_name("AT", k, radius, extra=short(column))
        found.append(N.standard(out, "betweenness", name + "S").select("line_id", F.col("betweenness").alias(name), name + "S"))
    return wide(lines, found)


def od_betweenness_analysis(lines: DataFrame, origins: DataFrame, destinations: DataFrame, radii: list[float | Radius | None], closest: bool = False, kind: str = "walking") -> DataFrame:
    """A number is a limit by walking; points without a column weight count 1 each."""
    every = [r if isinstance(r, Radius) else Radius(walking=r) for r in radii]
    return wide(lines, [paths.od_betweenness(lines, origins, destinations, closest=closest, kind=kind, radius=r).withColumnRenamed("score", column_name("OD", kind, r)) for r in every])


def grouping_analysis(lines: DataFrame, threshold: float, split: bool = False) -> DataFrame:
    groups, end = grouping.grouping(lines, threshold, split), f"{threshold:g}" + "_split" * split
    return wide(lines, [groups.withColumnRenamed("group_id", f"seggrp_id_{end}"), grouping.group_colours(lines, groups).withColumnRenamed("colour", f"seggrp_color_{end}")])


def group_integration_analysis(lines: DataFrame, threshold: float, radii: list[Radius], split: bool = False) -> DataFrame:
    groups, found = grouping.grouping(lines, threshold, split), []
    for r in radii:
        name = column_name(f"GI_{threshold:g}" + "_sp" * split, "", r)
        out = grouping.group_integration(lines, groups, r, connected=True)
        out = out.select("group_id", F.col("integration").alias(name), F.col("node_count").alias(name + "N"), F.col("total_depth").alias(name + "T"), N.mean_depth(F.col("node_count"), F.col("total_depth")).alias(name + "M"))
        found.append(groups.join(out, "group_id").drop("group_id"))
    return wide(lines, found)


def compare_analysis(before: DataFrame, after: DataFrame, pixel: int, blur: float | None = None) -> DataFrame:
    sigma = (blur or 7.0 * pixel) / pixel
    return raster.polygons(raster.compare_normalized(before, after, float(pixel), sigma), resolution=float(pixel))


def isovist_analysis(origins: DataFrame, obstacles: DataFrame, distance: float, points: dict[str, DataFrame] | None = None, regions: dict[str, DataFrame] | None = None) -> DataFrame:
    """Views of 360 degrees with 64 sides, the obstacles in sight, and how many points and regions of each layer they hold or touch."""
    sights = cut(isovist.sights(origins, obstacles, distance))
    views = sights.withColumn("pt_id", F.struct("x", "y"))
    out = isovist.seen_by(origins, sights).withColumns({"max_dist": F.lit(float(distance)), "fov_angle": F.lit(360.0), "direction": F.lit(0.0)})
    regions_in_sight = lambda *given: isovist.visible_regions(*given).groupBy("pt_id").agg(F.count(F.lit(1)).alias("n"))
    for find, layers in ((isovist.points_in_sight, points), (regions_in_sight, regions)):
        for name, layer in (layers or {}).items():
            seen = find(views, layer, distance).select("pt_id.x", "pt_id.y", F.col("n").alias(f"n_{name}"))
            out = out.join(seen.hint("merge"), ["x", "y"], "left").fillna(0, [f"n_{name}"])
    return out.select("pt_id", *(c for c in out.columns if c != "pt_id"))


def segment_map_analysis(polylines: DataFrame, snap: float = 1.0, copied: list[str] = [], **options) -> tuple[DataFrame, DataFrame | None]:  # noqa: B006
    found, unlinks = segment_map.segment_map(polylines, snap_distance=snap, extrude=snap, **options)
    return segment_map.with_base_columns(found, polylines, copied) if copied else found, unlinks


def junctions_analysis(layer: DataFrame, other: DataFrame | None = None, unlinks: DataFrame | None = None) -> DataFrame:
    points = axial.junctions(layer, other, unlinks).withColumn("key", F.struct("x", "y"))
    return grouping.numbered(points, "key", "id").select("id", "x", "y")


def split_polylines_analysis(polylines: DataFrame, copied: list[str] = []) -> DataFrame:  # noqa: B006
    return segment_map.split_polylines(polylines, tuple(copied))
