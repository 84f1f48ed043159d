"""Points and outlines at one place are searched for once; what is on an outline."""

from networks import frame
from pyspark.sql import functions as F

from urbangraph.functions import geometry as G
from urbangraph.operators import axial, grid, isovist, multidistance, paths, raster, reach
from urbangraph.radii import Radius


def copies(spark, places, n, extra=""):
    rows = [(k * n + i, float(x), float(y)) for k, (x, y) in enumerate(places) for i in range(n)]
    return spark.createDataFrame(rows, "pt_id long, x double, y double")


def given(monkeypatch, module, name, at=0):
    """The numbers of rows that a function is called with."""
    whole, seen = getattr(module, name), []

    def counted(*args, **named):
        seen.append(args[at].count())
        return whole(*args, **named)

    monkeypatch.setattr(module, name, counted)
    return seen


def test_nearest_line_asks_once_for_a_place(spark, monkeypatch):
    seen = given(monkeypatch, grid, "points_near_lines")
    lines = frame(spark, [(0, 0, 100, 0), (0, 50, 100, 50)])
    points = copies(spark, [(10, 5), (20, 48)], 40).union(spark.createDataFrame([(0, 20.0, 49.0), (99, None, 1.0)], "pt_id long, x double, y double"))
    found = {r.pt_id: (r.line_id, r.d) for r in axial.nearest_line(points, lines).collect()}
    assert seen == [3]
    assert len(found) == 80 and found[0] == (1, 1.0) and found[39] == (0, 5.0) and found[79] == (1, 2.0)


def test_straight_distances_pair_places(spark, monkeypatch):
    origins, targets = (given(monkeypatch, reach, "straight_pairs", at) for at in (0, 1))
    points = copies(spark, [(0, 0), (900, 0)], 30).union(spark.createDataFrame([(99, None, 1.0)], "pt_id long, x double, y double"))
    attractions = copies(spark, [(0, 300), (40, 0)], 20).selectExpr("*", "if(pt_id = 0, -1.0D, 2.0D) as value")
    far = {r.pt_id: r.distance for r in reach.attraction_distance_straight(points, attractions, 500.0).collect()}
    assert len(far) == 61 and far[0] == far[29] == 40.0 and far[30] == far[99] == -1.0
    score = {r.pt_id: r.score for r in reach.attraction_reach_straight(points, attractions, 500.0).collect()}
    assert len(score) == 61 and score[0] == 39 * 2.0 and score[30] == score[99] == 0.0
    assert origins == targets == [2, 2]


def test_points_on_an_outline_are_not_inside(spark):
    ring = "array(struct(0.0D as x, 0.0D as y), struct(40.0D as x, 0.0D as y), struct(40.0D as x, 30.0D as y), struct(0.0D as x, 30.0D as y)) as ring"
    points = spark.createDataFrame([(0, 0.0, 10.0), (1, 5.0, 0.0), (2, 0.0, 0.0), (3, 5.0, 5.0), (4, 40.0, 10.0), (5, 39.0, 29.0)], "pt_id long, x double, y double")
    found = points.select("pt_id", "x", "y", F.expr(ring)).where(G.inside_ring(F.col("x"), F.col("y"), F.col("ring")))
    assert sorted(r.pt_id for r in found.collect()) == [3, 5]


def test_points_in_shapes_hold_places_against_outlines_once(spark, monkeypatch):
    left, right = (given(monkeypatch, grid, "overlapping", at) for at in (0, 1))
    ring = "array(struct(0.0D as x, 0.0D as y), struct(40.0D as x, 0.0D as y), struct(40.0D as x, 30.0D as y)) as ring"
    shapes = spark.range(25).select(F.col("id").alias("region_id"), F.expr(ring))
    points = copies(spark, [(20, 5), (90, 90)], 10)
    corners = tuple(F.lit(c) for c in (0.0, 0.0, 40.0, 30.0))
    assert grid.points_in_shapes(points, shapes, "ring", corners, G.in_ring).distinct().count() == 250
    assert (left, right) == ([2], [1])


def test_turns_alone_need_only_what_lies_around(spark, monkeypatch):
    limits, whole = [], paths.groups
    monkeypatch.setattr(paths, "groups", lambda lines, limit, *args, **named: limits.append(limit) or whole(lines, limit, *args, **named))
    squares = frame(spark, [(x + a, b, x + c, d) for x in (0, 9000) for a, b, c, d in ((0, 0, 100, 0), (100, 0, 100, 100), (100, 100, 0, 100), (0, 100, 0, 0))] + [(20000, 0, 30000, 0), (30000, 0, 40000, 0)])
    found = {r.line_id: r.node_count for r in paths.angular_integration(squares, Radius(angular=100.0)).collect()}
    assert limits == [2000.0, 8000.0, 32000.0]
    assert found == {**dict.fromkeys(range(8), 3), 8: 2, 9: 2}


def test_obstacles_with_the_same_rings_are_one(spark):
    rings = {"a": [(30.0, -20.0), (40.0, -20.0), (40.0, 20.0), (30.0, 20.0)], "b": [(-60.0, -60.0), (60.0, -60.0), (60.0, 60.0), (-60.0, 60.0)]}
    rows = [(i, rings["a"]) for i in range(5, 15)] + [(1, rings["a"]), (1, rings["b"])]
    obstacles = spark.createDataFrame(rows, "group_id long, ring array<struct<x:double,y:double>>")
    assert isovist.distinct_obstacles(obstacles).count() == 3
    origins = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (2, None, 0.0)], "pt_id long, x double, y double")
    assert isovist.sights(origins, obstacles, 100.0).count() == 1
    assert {r.pt_id: r.obstacles for r in isovist.isovists(origins, obstacles, 100.0).collect()} == {0: [5], 1: [5], 2: None}


def test_flows_search_once_for_a_place(spark, monkeypatch):
    seen = given(monkeypatch, axial, "nearest_line")
    lines = frame(spark, [(0, 0, 100, 0), (100, 0, 200, 0), (200, 0, 300, 0)])
    origins, ends = copies(spark, [(20, 5), (50, 5)], 30), copies(spark, [(280, 5)], 4)
    found = {r.line_id: round(r.score, 6) for r in paths.od_betweenness(lines, origins, ends, 800.0).collect()}
    assert seen == [2, 1] and found == {0: 60.0, 1: 60.0, 2: 60.0}


def test_rasters_shuffle_lines_not_samples(spark):
    lines = frame(spark, [(0, 0, 5000, 0), (0, 10, 3000, 4010)]).withColumn("value", F.lit(1.0))
    for made in (raster.raster_lines(lines, 10.0), raster.compare_percent(lines, lines, 10.0, 2.0, 1.0)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" in plan and "Join" not in plan and "Aggregate" not in plan
    assert abs(raster.raster_lines(lines, 10.0).agg(F.sum("value")).first()[0] - 1000) < 1e-6


def test_starts_on_a_line_do_not_lengthen_a_search(spark, monkeypatch):
    seen = given(monkeypatch, multidistance, "search")
    g = axial.graph(frame(spark, [(0, 0, 100, 0), (100, 0, 100, 100)]))
    points = spark.createDataFrame([(i, float(i % 20), 0.0, 1.0) for i in range(40)], "pt_id long, x double, y double, value double")
    edges = multidistance.Network(g, multidistance.from_points(g, points), through=False).edges(("walking",))
    assert edges.where("src.line = 0 and dst.line = 0").select("dst").distinct().count() == 1
    found = {r.target: r.score for r in multidistance.attraction_reach(g, points, "walking", Radius(walking=140.0)).collect()}
    assert seen == [40] and found == {0: 40.0, 1: 20.0}
    assert {r.target: r.score for r in multidistance.attraction_reach(g, points, "steps", Radius(steps=1)).collect()} == {0: 40.0, 1: 40.0}
    assert len(seen) == 1
