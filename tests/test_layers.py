import collections
import math
import random

import pytest
from networks import by_line, chain, frame, square
from pyspark.sql import functions as F

from urbangraph.functions import geometry as G
from urbangraph.functions import naming
from urbangraph.functions import normalize as N
from urbangraph.operators import axial, isovist, raster, segment_map
from urbangraph.radii import Radius
from urbangraph.sources import layers


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_angles_and_positions(spark):
    x = lambda v: F.lit(float(v))
    assert one(spark, G.orientation(x(0), x(-1)), G.angle_between(x(350), x(20)), G.reversed_angle(x(200)), G.reversed_angle(x(10))) == [270, 30, 20, 190]
    assert one(spark, G.point_segment_distance(x(0), x(3), x(-1), x(0), x(1), x(0)), G.nearest_position(x(9), x(9), x(2), x(2), x(2), x(2))) == [3, 0]
    keys = [one(spark, G.order_key(x(math.cos(a)), x(math.sin(a))))[0] for a in (0.1, 1, 2, 3, 4, 5, 6)]
    assert keys == sorted(keys) and 0 <= keys[0] and keys[-1] < 4
    assert G.equal_area_scale(4) == pytest.approx(math.sqrt(math.pi / (4 * math.sin(math.pi / 4) * math.cos(math.pi / 4))))
    assert sum(G.gaussian_kernel(1.5)) == pytest.approx(1)


def test_rings(spark):
    ring = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 2), (0, 2))))
    assert one(spark, G.ring_area(ring), *G.ring_centroid(ring), G.in_ring(F.lit(1.0), F.lit(1.0), ring), G.in_ring(F.lit(5.0), F.lit(1.0), ring)) == [8, 2, 1, True, False]
    line = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(0.0).alias("y")) for a in (0, 2)))
    assert one(spark, *G.ring_centroid(line)) == [1, 0]


def test_normalisations(spark):
    df = spark.createDataFrame([(i, float(i), i) for i in range(1, 6)], "line_id long, x double, n long")
    assert by_line(N.standard(df, "x", "s"), "s") == [0, 0.25, 0.5, 0.75, 1]
    assert by_line(df.withColumn("s", N.choice(F.col("x"), F.col("n"))), "s") == pytest.approx([1, 2, 1.5, 4 / 6, 5 / 12])
    assert by_line(N.standard(df.withColumn("x", F.lit(2.0)), "x", "s"), "s") == [1] * 5
    got = by_line(spark.createDataFrame([(1, 1, 0.0), (2, 2, 1.0), (3, 5, 10.0)], "line_id long, n long, td double").withColumn("s", N.network_integration(F.col("n"), F.col("td"))), "s")
    assert got[0] == -1 and got[1] is None and got[2] == pytest.approx(0.352, abs=1e-3)


def test_readers_and_sinks(spark):
    rows = [(1, "LINESTRING (0 0, 1 2)"), (2, "LINESTRING (3 4)"), (3, "POLYGON ((0 0, 2 0, 2 2, 0 0))")]
    layer = spark.createDataFrame(rows, "id long, wkt string").withColumn("coords", layers.from_wkt(F.col("wkt")))
    assert [tuple(r) for r in layers.lines(layer.where("id < 3"), row_id="id").collect()] == [(1, 0, 0, 1, 2)]
    with pytest.raises(Exception, match="more than two points"):
        layers.lines(layer, row_id="id").collect()
    ring = layers.regions(layer.where("id = 3"), "coords", "id").first()
    assert len(ring["ring"]) == 3
    gj = spark.createDataFrame([('{"type":"LineString","coordinates":[[1,2],[3,4]]}',)], "j string").select(layers.from_geojson(F.col("j")).alias("c")).first()
    assert [(p.x, p.y) for p in gj["c"]] == [(1, 2), (3, 4)]
    base = spark.createDataFrame([(1, 5), (2, 6)], "line_id long, old int")
    out = layers.with_columns(base, spark.createDataFrame([(1, 9)], "line_id long, old int"), "line_id").orderBy("line_id").collect()
    assert [tuple(r) for r in out] == [(1, 9), (2, None)]
    assert layers.described(base) == [("line_id", "integer"), ("old", "integer")]


def test_names():
    assert naming.column_name("AC", "", Radius(walking=2000), weight="wl", normalisation="C") == "ACw2kwlC"
    assert Radius().split() == [Radius()] and Radius(steps=2, walking=5.0).split() == [Radius(walking=5.0), Radius(steps=2)]


def test_axial_graph_and_junctions(spark):
    tee = frame(spark, [(0, 0, 2, 0), (1, 1, 1, -1), (1, -1, 2, -1)])
    unlink = spark.createDataFrame([(0, 1.0, 0.0)], "pt_id long, x double, y double")
    point = spark.createDataFrame([(0, -1.0, 0.0)], "pt_id long, x double, y double")
    info = axial.graph_info(axial.graph(tee, unlink), point).first()
    assert (info.n_lines, info.n_crossings, info.n_points) == (3, 1, 1)
    assert axial.graph_info(axial.graph(tee)).first().n_crossings == 2
    a, b = frame(spark, [(0, -1, 0, 1)]), frame(spark, [(-1, 0, 1, 0)])
    assert axial.junctions(a, b).count() == 1
    assert axial.junctions(a, b, spark.createDataFrame([(0, 0.0, 0.0)], "pt_id long, x double, y double")).count() == 0
    assert axial.junctions(frame(spark, [(0, 0, 1, 0), (0, 0, 0, 1)])).count() == 0
    assert axial.junctions(frame(spark, [(0, 0, 1, 0), (0, 0, 0, 1), (0, 0, -1, 0)])).count() == 1


def test_two_unlinks_take_two_crossings(spark):
    lines = frame(spark, [(0, 0, 10, 0), (2, -1, 2, 1), (3, -1, 3, 1)])
    two = spark.createDataFrame([(0, 2.0, 0.0), (1, 2.1, 0.0)], "pt_id long, x double, y double")
    assert axial.without_unlinks(axial.crossing_pairs(lines), two).count() == 0


def test_isovist_without_obstacles(spark):
    at = spark.createDataFrame([(0, 0.0, 0.0)], "pt_id long, x double, y double")
    none = spark.createDataFrame([], "group_id long, ring array<struct<x:double,y:double>>")
    view = isovist.isovists(at, none, 1.0, sides=4).first()
    assert len(view["polygon"]) == 4 and view["area"] == pytest.approx(math.pi)
    assert all(math.hypot(p.x, p.y) == pytest.approx(G.equal_area_scale(4)) for p in view["polygon"])
    wall = spark.createDataFrame([(0, [(0.5, -5.0), (0.6, -5.0), (0.6, 5.0), (0.5, 5.0)])], "group_id long, ring array<struct<x:double,y:double>>")
    hidden = isovist.isovists(at, wall, 1.0, sides=64)
    assert hidden.first()["area"] < math.pi - 0.3
    seen = isovist.visible_points(hidden, spark.createDataFrame([(1, 0.8, 0.0), (2, -0.8, 0.0)], "pt_id long, x double, y double"), 1.0)
    assert [r.seen_id for r in seen.collect()] == [2]


def test_segment_map(spark):
    rows = [(0, [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)]), (1, [(10.2, -20.0), (10.0, 20.0)]), (2, [(0.0, 0.0), (0.0, 3.0)])]
    poly = spark.createDataFrame(rows, "base_id long, coords array<struct<x:double,y:double>>")
    found, _ = segment_map.segment_map(poly, snap_distance=0.5, tail=0.0, deviation=0.0)
    assert found.count() == 5
    ends = {(r.x1, r.y1) for r in found.collect()} | {(r.x2, r.y2) for r in found.collect()}
    assert sum(1 for x, y in ends if abs(x - 10) < 1 and abs(y) < 1) == 1  # the cut and the corner became one point
    road, unlinks = segment_map.segment_map(poly, road_centre_lines=True, snap_distance=0.0, tail=0.0, deviation=0.0)
    assert road.count() == 4 and unlinks.count() >= 1
    joined, _ = segment_map.segment_map(poly.where("base_id = 0"), snap_distance=0.0, tail=0.0, deviation=1.0)
    assert [tuple(sorted([r.x1, r.x2])) for r in joined.collect()] == [(0, 20)]


@pytest.mark.parametrize("pieces", [2, 3])
def test_trim_tails_walks_chains(spark, pieces):
    street = [(-100, 0, 0, 0), (0, 0, 100, 0), (100, 0, 100, 100), (100, 100, -100, 0)]
    drawn = [(0, 3 * k, 0, 3 * k + 3) if k % 2 else (0, 3 * k + 3, 0, 3 * k) for k in range(pieces)]  # in either direction
    alone = [(500, 3 * k, 500, 3 * k + 3) for k in range(pieces)]  # has two dead ends and no junction
    lines = frame(spark, street + drawn + alone)
    whole, kept = list(range(4 + 2 * pieces)), [*range(4), *range(4 + pieces, 4 + 2 * pieces)]
    assert by_line(segment_map.trim_tails(lines, 3.0 * pieces), "line_id") == whole
    assert by_line(segment_map.trim_tails(lines, 3.0 * pieces + 1), "line_id") == kept


def test_trim_tails_counts_junctions_beforehand(spark):
    # both tails of a fork go, but not the stem, which becomes a dead end only then
    fork = frame(spark, [(-100, 0, 0, 0), (0, 0, 100, 0), (0, 0, 0, 6), (0, 6, 3, 9), (0, 6, -3, 9)])
    assert by_line(segment_map.trim_tails(fork, 10.0), "line_id") == [0, 1, 2]


def plain_detail(rows, deviation):
    """rows: (line_id, base_id, start, end). Segments one after the other, each walking on from its end."""
    line = {i: [base, a, b] for i, base, a, b in rows}
    number = collections.Counter(p for _, _, a, b in rows for p in (a, b))
    for one in sorted(line):
        while one in line:
            base, start, end = line[one]
            others = [k for k, (_, a, b) in line.items() if k != one and end in (a, b)]
            if number[end] != 2 or len(others) != 1 or line[others[0]][0] != base:
                break
            _, a, b = line[others[0]]
            far = b if a == end else a
            height = abs((end[0] - start[0]) * (far[1] - start[1]) - (end[1] - start[1]) * (far[0] - start[0])) / (math.dist(start, far) or 1)
            if far == start or height > deviation:
                break
            line[one] = [base, start, far]
            del line[others[0]]
    return sorted((i, base, *a, *b) for i, (base, a, b) in line.items())


def test_remove_detail_by_distance_from_the_chord(spark):
    shape = "line_id long, base_id long, x1 double, y1 double, x2 double, y2 double"
    detail = lambda rows, d: sorted(tuple(r) for r in segment_map.remove_detail(spark.createDataFrame([(i, b, *a, *c) for i, b, a, c in rows], shape).repartition(3), d).select("line_id", "base_id", "x1", "y1", "x2", "y2").collect())
    assert detail([(0, 0, (0.0, 0.0), (50.0, 0.5)), (1, 0, (50.0, 0.5), (100.0, 0.0))], 1.0) == [(0, 0, 0.0, 0.0, 100.0, 0.0)]  # turns by 1.15 degrees
    bend = [(500.0 * k, 500.0 * k * math.tan(math.radians(0.45 * k))) for k in range(6)]
    far_off = [(k, 0, bend[k], bend[k + 1]) for k in range(5)]
    assert len(detail(far_off, 1.0)) == 5  # turns by less than a degree, but metres off
    assert detail([], 1.0) == []
    rng, rows = random.Random(11), []
    for base in range(40):
        at, points = (1000.0 * base, 0.0), []
        for _ in range(rng.randrange(2, 14)):
            points.append(at)
            at = (at[0] + rng.uniform(5, 40), at[1] + rng.uniform(-2, 2))
        pieces = list(zip(points, points[1:] + [at], strict=True))
        order = rng.sample(range(100), len(pieces)) if base % 3 == 0 else list(range(len(pieces)))
        for (a, b), place in zip(pieces, sorted(order) if base % 2 else order, strict=True):
            a, b = (b, a) if base % 3 == 0 and rng.random() < 0.5 else (a, b)
            rows.append((100 * base + place, None if base == 7 else base if rng.random() < 0.9 else base + 500, a, b))
        if base % 4 == 0:  # a side street in the middle
            rows.append((100 * base + 99_000, base, points[len(points) // 2], (points[len(points) // 2][0], 90.0)))
    rows += [(200_000 + k, 9000, (-10.0 + 3 * math.cos(k * math.pi / 3), 3 * math.sin(k * math.pi / 3)), (-10.0 + 3 * math.cos((k + 1) % 6 * math.pi / 3), 3 * math.sin((k + 1) % 6 * math.pi / 3))) for k in range(6)]  # a ring
    for deviation in (0.5, 1.5, 10.0):
        assert detail(rows, deviation) == plain_detail(rows, deviation), deviation


def test_unlinks_take_all_cuts_of_a_point(spark):
    shape = "base_id long, coords array<struct<x:double,y:double>>"
    unlink = lambda x, y: spark.createDataFrame([(0, x, y)], "pt_id long, x double, y double")
    pieces = lambda lines, u: segment_map.segment_map(spark.createDataFrame([(i, [(float(a), float(b)), (float(c), float(d))]) for i, (a, b, c, d) in enumerate(lines)], shape), unlinks=u, snap_distance=0.0, tail=0.0, deviation=0.0)[0].count()
    three, tee = [(-10, 0, 10, 0), (0, -10, 0, 10), (-10, -10, 10, 10)], [(-10, 0, 10, 0), (0, 0, 0, 10)]
    assert pieces(three, None) == 6 and pieces(three, unlink(0.5, 0.0)) == 3
    assert pieces(tee, None) == 3 and pieces(tee, unlink(0.5, 0.0)) == 2
    assert pieces(tee, unlink(0.0, -99.9)) == 2 and pieces(tee, unlink(0.0, -100.0)) == 3


def test_unlinked_points_take_turns(spark):
    rng = random.Random(5)
    made = [(0, y, 100, y) for y in (0, 5, 10)] + [(x, -5, x, 15) for x in range(5, 95, 6)]
    cuts = segment_map.cuts(frame(spark, made))
    points = sorted({(r.x, r.y) for r in cuts.collect()})
    unlinks = [(i, rng.uniform(20, 60), rng.uniform(-2, 9)) for i in range(30)]
    left = list(points)
    for _, x, y in unlinks:
        left.remove(min(left, key=lambda p: (math.dist(p, (x, y)), p)))
    found = axial.without_unlinked_points(cuts, spark.createDataFrame(unlinks, "pt_id long, x double, y double").repartition(3), 100.0)
    assert sorted({(r.x, r.y) for r in found.collect()}) == left


def test_raster(spark):
    lines = frame(spark, chain(1, 4)).withColumn("value", F.lit(2.0))
    assert raster.raster_lines(lines, 1.0).agg(F.sum("value")).first()[0] == pytest.approx(8)
    assert raster.gaussian_blur(raster.raster_lines(lines, 1.0), 1.0).agg(F.sum("value")).first()[0] == pytest.approx(8)
    same = raster.compare_normalized(lines, lines, 1.0, 1.0)
    assert same.agg(F.max(F.abs("value"))).first()[0] == pytest.approx(0, abs=1e-9)


def test_outlines(spark):
    shape = "ix int, iy int, value double"
    block = [(x, y, 0.2) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    (one,) = raster.polygons(spark.createDataFrame(block, shape), resolution=2.0).collect()
    assert (one.category, one.range_min, one.range_max) == (5, 0.1, 0.25)
    assert [[(p.x, p.y) for p in r] for r in one.rings] == [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (2, 4), (4, 4), (4, 2)]]
    corner = [(0, 0, 0.2), (1, 1, 0.2), (5, 5, 0.7), (9, 9, None), (8, 8, 0.0)]  # two pixels that meet at a corner, one of another range
    assert sorted((r.category, len(r.rings), len(r.rings[0])) for r in raster.polygons(spark.createDataFrame(corner, shape)).collect()) == [(5, 1, 4), (5, 1, 4), (7, 1, 4)]
    assert raster.polygons(spark.createDataFrame([], shape)).count() == 0
    rng = random.Random(6)
    pixels = {(x, y) for x in range(24) for y in range(16) if rng.random() < 0.62}
    drawn_from = spark.createDataFrame([(x - 9, y - 9, 0.2) for x, y in pixels], shape).repartition(3)
    whole = {(r.category, r.polygon, str(r.rings)) for r in raster.polygons(drawn_from).collect()}
    assert {(r.category, r.polygon, str(r.rings)) for r in raster.polygons(drawn_from, tile=5).collect()} == whole  # tiles change nothing
    found = raster.polygons(spark.createDataFrame([(x, y, 0.2) for x, y in pixels], shape)).collect()
    groups, left = [], set(pixels)
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            group.add((x, y))
            near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & left
            left -= near
            todo += near
        groups.append(group)
    area = lambda r: sum(a.x * b.y - b.x * a.y for a, b in zip(r, [*r[1:], r[0]], strict=True)) / 2
    inside = lambda r, x, y: sum((a.y > y) != (b.y > y) and a.x > x for a, b in zip(r, [*r[1:], r[0]], strict=True)) % 2 == 1
    drawn = []
    for r in found:
        assert area(r.rings[0]) > 0 and all(area(h) < 0 for h in r.rings[1:])
        drawn.append({(x, y) for x in range(24) for y in range(16) if inside(r.rings[0], x + 0.5, y + 0.5) and not any(inside(h, x + 0.5, y + 0.5) for h in r.rings[1:])})
    assert sorted(map(sorted, drawn)) == sorted(map(sorted, groups))


def test_nearest_line_far_off_and_without_coordinates(spark):
    lines = frame(spark, [(0, 0, 10, 0), (0, 50, 10, 50)])
    at = spark.createDataFrame([(0, 5.0, 1.0), (1, 9000.0, 60.0), (2, None, 1.0), (3, 1.0, None), (4, 5.0, 25.0)], "pt_id long, x double, y double")
    assert {r.pt_id: r.line_id for r in axial.nearest_line(at, lines).collect()} == {0: 0, 1: 1, 4: 0}
    assert axial.nearest_line(at, lines.limit(0)).count() == 0


def test_square_lengths(spark):
    assert axial.with_length(frame(spark, square(3))).agg(F.sum("length")).first()[0] == 12


def test_gaussian_kernel_values():
    share = lambda x: math.erf(x / math.sqrt(2))
    half = [(share((i + 0.5) * 6 / 7) - share((i - 0.5) * 6 / 7)) / 2 / share(3) for i in range(4)]
    assert G.gaussian_kernel(1.0) == pytest.approx([*half[:0:-1], *half], abs=2e-4)


def test_unlinks_take_turns(spark):
    rng = random.Random(4)
    made = [(0, 0, 100, 0), (0, 7, 100, 7)] + [(x, -5, x + rng.uniform(-3, 3), 12) for x in range(5, 95, 6)]
    lines = frame(spark, made)
    crossings = [tuple(r) for r in axial.crossing_pairs(lines).select("line_a", "line_b", "x", "y", "t_a").collect()]
    unlinks = [(i, rng.uniform(20, 60), rng.uniform(-2, 9)) for i in range(18)]
    left = sorted(c for c in crossings)
    for _, x, y in unlinks:
        inner = [c for c in left if c[4] not in (0.0, 1.0)]
        left.remove(min(inner, key=lambda c: (math.hypot(c[2] - x, c[3] - y), c[0], c[1])))
    df = spark.createDataFrame(unlinks, "pt_id long, x double, y double").repartition(3)
    found = axial.without_unlinks(axial.crossing_pairs(lines), df)
    assert sorted((r.line_a, r.line_b) for r in found.collect()) == sorted(c[:2] for c in left)
    row = frame(spark, [(-20, 0, 20, 0)] + [(x, -1, x, 1) for x in (-7, 0, 2, 10)])
    three = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.1, 0.0), (2, 2.0, 0.0)], "pt_id long, x double, y double")
    assert [r.x for r in axial.without_unlinks(axial.crossing_pairs(row), three).collect()] == [-7.0]
    assert axial.without_unlinks(axial.crossing_pairs(row), three.limit(0)).count() == 4


def plain_region_points(ring, interval):
    out, t, n = [ring[0]], interval, len(ring)
    for i, (x, y) in enumerate(ring):
        to = ring[(i + 1) % n]
        whole = math.hypot(to[0] - x, to[1] - y)
        if whole:
            length = whole - (0.5 * interval if i == n - 1 else 0)
            while t < length:
                out.append((x + (to[0] - x) * t / whole, y + (to[1] - y) * t / whole))
                t += interval
            t -= length
    return out


def test_region_points_against_a_walk(spark):
    rng = random.Random(9)
    rings = [[(0, 0), (15, 0), (15, 10), (0, 10)], [(0, 0), (40, 0), (40, 5), (0, 5)], [(0, 0), (0, 0), (30, 0), (30, 1), (30, 1)], [(1, 2), (1, 2)], [(0, 0), (3, 0), (3, 3)]]
    rings += [[(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(rng.randint(3, 9))] for _ in range(30)]
    rows = [(i, [(float(x), float(y)) for x, y in ring]) for i, ring in enumerate(rings)]
    found = {}
    for r in segment_map.region_points(spark.createDataFrame(rows, "region_id long, ring array<struct<x:double,y:double>>"), 20.0).orderBy("region_id", "k").collect():
        found.setdefault(r.region_id, []).append((r.x, r.y))
    for i, ring in rows:
        assert found[i] == [pytest.approx(p, abs=1e-6) for p in plain_region_points(ring, 20.0)], ring
    assert len(found[0]) == 2


def plain_view(at, rings, distance, fov=360.0, direction=0.0, sides=64):
    """Area and ids in sight: between any two neighbouring angles of ends and crossings the nearest wall is one wall."""
    outer, first, span = distance * G.equal_area_scale(sides), math.radians(direction - fov / 2), math.radians(fov)
    held = {g for g, _ in rings if sum(plain_inside(at, r) for h, r in rings if h == g) % 2}
    walls = [(g, a, b) for g, r in rings if g not in held for a, b in zip(r, r[1:] + r[:1], strict=True)]
    corner = [(at[0] + outer * math.cos(first + span * i / sides), at[1] + outer * math.sin(first + span * i / sides)) for i in range(sides + 1)]
    walls += [(None, a, b) for a, b in zip(corner, corner[1:], strict=False)]
    spots = [p for _, a, b in walls for p in (a, b)]
    for i, (_, a, b) in enumerate(walls):
        for _, c, d in walls[:i]:
            det = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if abs(det) > 1e-12:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / det
                spots.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    angles = sorted({0.0, span, *(t for p in spots if (t := (math.atan2(p[1] - at[1], p[0] - at[0]) - first) % (2 * math.pi)) < span)})
    area, seen = 0.0, set()
    for lo, hi in zip(angles, angles[1:], strict=False):
        if hi - lo < 1e-10:
            continue

        def reach(w, angle):
            _, a, b = w
            dx, dy, ex, ey = math.cos(angle + first), math.sin(angle + first), b[0] - a[0], b[1] - a[1]
            det = dx * ey - dy * ex
            if abs(det) < 1e-12:
                return math.inf
            t, u = ((a[0] - at[0]) * ey - (a[1] - at[1]) * ex) / det, ((a[0] - at[0]) * dy - (a[1] - at[1]) * dx) / det
            return t if t > 0 and -1e-9 <= u <= 1 + 1e-9 else math.inf

        best = min(walls, key=lambda w: reach(w, (lo + hi) / 2))
        seen.add(best[0])
        area += reach(best, lo + 1e-12) * reach(best, hi - 1e-12) * math.sin(hi - lo) / 2
    return area, sorted(seen - {None})


def plain_inside(at, ring):
    return sum((a[1] > at[1]) != (b[1] > at[1]) and a[0] + (at[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > at[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2


@pytest.mark.parametrize("fov,direction", [(360.0, 0.0), (110.0, 200.0)])
def test_isovists_among_random_obstacles(spark, fov, direction):
    """Obstacles cross each other, hold origins, have holes and lie on the circle."""
    draw = random.Random(5)
    rings = []
    for g in range(14):
        x, y, turn, n = draw.uniform(-9, 9), draw.uniform(-9, 9), draw.uniform(0, 6), draw.randint(3, 6)
        for size in (draw.uniform(0.5, 3),) if g % 5 else (2.0, 1.0):
            rings.append((g, [(x + size * math.cos(turn + 6.283 * i / n), y + size * math.sin(turn + 6.283 * i / n)) for i in range(n)]))
    at = [(i, draw.uniform(-8, 8), draw.uniform(-8, 8)) for i in range(12)]
    origins = spark.createDataFrame([*at, at[0], (99, None, 1.0)], "pt_id long, x double, y double")
    obstacles = spark.createDataFrame([*rings, (77, None), (78, [])], f"group_id long, ring {isovist.RING}")
    got = isovist.isovists(origins, obstacles, 6.0, fov, direction, 16).collect()
    assert sorted(r.pt_id for r in got) == sorted([*range(12), 0, 99])
    for r in got:
        if r.pt_id == 99:
            assert (r.polygon, r.area, r.obstacles) == (None, None, None)
            continue
        area, seen = plain_view((r.x, r.y), rings, 6.0, fov, direction, 16)
        assert r.area == pytest.approx(area, rel=1e-6) and r.obstacles == seen
        ring = [(p.x, p.y) for p in r.polygon]
        assert -sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2 == pytest.approx(r.area, rel=1e-6)
    assert isovist.isovists(origins.limit(0), obstacles, 6.0).count() == 0


def test_visible_regions(spark):
    """Regions around the origin, with a corner in sight, crossed by the outline, behind a wall and out of reach."""
    at = spark.createDataFrame([(0, 0.0, 0.0)], "pt_id long, x double, y double")
    wall = spark.createDataFrame([(0, [(2.0, -3.0), (2.1, -3.0), (2.1, 3.0), (2.0, 3.0)])], f"group_id long, ring {isovist.RING}")
    box = lambda a, b, c, d: [(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d))]
    regions = [(1, box(-50, -50, 50, 50)), (2, box(-1, 1, 0, 2)), (3, box(-6, -0.5, -4, 0.5)), (4, box(3, -1, 4, 1)), (5, box(20, 0, 21, 1)), (6, None)]
    views = isovist.isovists(at, wall, 5.0)
    seen = isovist.visible_regions(views, spark.createDataFrame(regions, f"region_id long, ring {isovist.RING}"), 5.0)
    assert sorted(r.seen_id for r in seen.collect()) == [1, 2, 3]
    assert views.first().obstacles == [0]


def test_polygons_with_holes(spark):
    rows = [(1, "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"), (2, "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)))"), (3, None), (4, "POLYGON EMPTY")]
    layer = spark.createDataFrame(rows, "id long, wkt string").withColumn("rings", layers.rings_from_wkt(F.col("wkt")))
    found = layers.polygons(layer, row_id="id")
    assert {r.region_id: r.rings and [len(x) for x in r.rings] for r in found.collect()} == {1: [4, 4], 2: [3], 3: None, 4: []}
    first = found.where("region_id = 1")
    at = lambda a, b: G.in_rings(F.lit(a), F.lit(b), F.col("rings"))
    assert list(first.select(at(1.0, 1.0), at(3.0, 3.0), at(5.0, 5.0), at(10.0, 1.0), G.rings_area(F.col("rings"))).first()) == [True, False, True, False, 77]
    with pytest.raises(Exception, match="more than one part"):
        spark.createDataFrame([("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",)], "w string").select(layers.rings_from_wkt(F.col("w"))).collect()
    json = ['{"type":"Polygon","coordinates":[[[0,0],[9,0],[9,9],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]]]}']
    got = spark.createDataFrame([(j,) for j in json], "j string").select(layers.rings_from_geojson(F.col("j")).alias("r")).collect()
    assert [[len(x) for x in r.r] for r in got] == [[4, 4], [4]] and got[1].r[0][1] == (2, 0)
    with pytest.raises(Exception, match="more than one part"):
        two = '{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}'
        spark.createDataFrame([(two,)], "j string").select(layers.rings_from_geojson(F.col("j"))).collect()
    rings = [[(0.0, 0.0), (50.0, 0.0), (50.0, 30.0)], [(5.0, 5.0), (9.0, 5.0), (9.0, 50.0)]]
    points = segment_map.region_points(spark.createDataFrame([(1, rings), (2, None), (3, [])], "region_id long, rings array<array<struct<x:double,y:double>>>"), 20.0).orderBy("k").collect()
    want = [p for ring in rings for p in plain_region_points(ring, 20.0)]
    assert [r.k for r in points] == list(range(len(want))) and [(r.x, r.y) for r in points] == [pytest.approx(p) for p in want]


def test_outlines_hold_a_ring_a_row(spark, monkeypatch):
    rng = random.Random(7)
    pixels = spark.createDataFrame([(x, y, 0.2 if rng.random() < 0.7 else 0.05) for x in range(40) for y in range(30)], "ix int, iy int, value double").repartition(3)
    whole = {(r.category, r.polygon): r.rings for r in raster.polygons(pixels, resolution=2.0).collect()}
    assert max(map(len, whole.values())) > 20  # many holes
    monkeypatch.setattr(raster, "RUNS", 7)
    monkeypatch.setattr(raster, "CORNERS", 5)
    rows = raster.outlines(pixels, resolution=2.0, tile=9).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.place):
        found.setdefault((r.category, r.polygon), []).append(r.ring)
    assert found == whole and len(rows) == sum(map(len, whole.values()))
