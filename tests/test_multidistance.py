"""Paths with several distances against all walks within the limits."""

import itertools
import math

import pytest
from networks import by_line, chain, frame, square
from test_paths import crooked

from urbangraph.operators import axial, multidistance, reach
from urbangraph.radii import Radius


def made(seed):
    return [*crooked(seed, 3), (-60, 95, 260, 120)]  # and a long line that crosses others in the middle


class Plain:
    """All walks from a place on a line, as far as the limits let them go."""

    def __init__(self, lines, crossings):
        self.lines = lines
        self.length = [math.dist(x[:2], x[2:]) for x in lines]
        self.way = [math.degrees(math.atan2(d - b, c - a)) % 360 for a, b, c, d in lines]
        self.at = {i: sorted((t, c) for j, c, t in crossings if j == i) for i in range(len(lines))}
        self.on = {c: sorted(j for j, d, _ in crossings if d == c) for _, c, _ in crossings}

    def heading(self, line, t, to):
        return self.way[line] if to > t else (self.way[line] + 180) % 360

    def turn(self, a, b):
        return 0.0 if a is None else 180 - abs(abs(a - b) % 360 - 180)

    def walk(self, line, t, limits, origin, d=0.0, weight=None):
        """Yields (line, t, heading before, walking, steps, angular, axmeter, weights, passed) of each entry into a line."""
        ok = lambda v: all(v[k] <= x + 1e-9 for k, x in limits.items() if k != "straight")
        first = {"walking": d, "steps": 0, "angular": 0.0, "axmeter": d, "weights": 0.0}
        todo = [(line, t, None, None, first, frozenset())] if ok(first) else []
        while todo:
            line, t, came, crossing, v, passed = todo.pop()
            yield line, t, came, v
            for to, c in self.at[line]:
                x, y = map(float, c.split(","))
                if c == crossing or math.dist((x, y), origin) > limits.get("straight", math.inf):
                    continue
                part = abs(to - t)
                head = came if to == t else self.heading(line, t, to)
                new = dict(v, walking=v["walking"] + part * self.length[line], axmeter=v["axmeter"] + part * self.length[line] * (v["steps"] + 1), weights=v["weights"] + part * (weight or {}).get(line, 0.0))
                if to != t:
                    new["angular"] += self.turn(came, head)
                if not ok(new):
                    continue
                yield ("crossing", c, None, new)
                new = dict(new, steps=v["steps"] + 1)
                for other in self.on[c]:
                    if other != line and ok(new) and (line, c, other) not in passed:
                        s = next(s for s, k in self.at[other] if k == c)
                        todo.append((other, s, head, c, new, passed | {(line, c, other)}))

    def least(self, walks, place, limits, kind, axmeter=False):
        """The least distance by kind to a place (line, t, off) among walks."""
        best = math.inf
        for line, t, came, v in walks:
            if line != place[0]:
                continue
            part, off = abs(place[1] - t), place[2]
            ways = {self.way[line], (self.way[line] + 180) % 360} if place[1] == t else {self.heading(line, t, place[1])}
            leg = part * self.length[line] + off
            end = dict(v, walking=v["walking"] + leg, angular=v["angular"] + min(self.turn(came, w) for w in ways), axmeter=v["axmeter"] + axmeter * leg * (v["steps"] + 1))
            if all(end[k] <= x + 1e-9 for k, x in limits.items() if k != "straight"):
                best = min(best, end[kind])
        return best


def network(spark, seed):
    lines = made(seed)
    g = axial.graph(frame(spark, lines))
    return lines, g, Plain(lines, [(r.line_id, r.crossing, r.t) for r in g["line_crossings"].collect()])


CASES = [({"walking": 260.0, "steps": 2}, "angular", 1), ({"axmeter": 420.0, "angular": 150.0}, "axmeter", 4), ({"walking": 250.0, "straight": 160.0}, "steps", 5)]


@pytest.mark.parametrize(("limits", "kind", "seed"), CASES)
def test_depths_with_several_limits(spark, limits, kind, seed):
    lines, g, plain = network(spark, seed)
    middle = [((a + c) / 2, (b + d) / 2) for a, b, c, d in lines]
    n = len(lines)
    walks = [[w for w in plain.walk(o, 0.5, limits, middle[o]) if w[0] != "crossing"] for o in range(n)]
    want = {(o, i): plain.least(walks[o], (i, 0.5, 0.0), limits, kind) for o, i in itertools.product(range(n), range(n))}
    want = {k: v for k, v in want.items() if v < math.inf}
    found = {(r.origin, r.target): r.d for r in multidistance.reached(g, multidistance.from_lines(g), kind, Radius(**limits)).collect()}
    assert found == pytest.approx(want, abs=1e-4)
    if kind == "steps":
        out = reach.network_integration(g, Radius(**limits))
        assert by_line(out, "total_depth") == pytest.approx([sum(d for (o, _), d in want.items() if o == k) for k in range(n)])
        assert by_line(reach.reach(g, Radius(**limits), area=False), "reach_count") == by_line(out, "node_count")


def places(points, lines):
    out = {}
    for i, x, y in points:
        best = None
        for k, (a, b, c, d) in enumerate(lines):
            t = max(0.0, min(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
            best = min(best or (math.inf,), (math.dist((x, y), (a + (c - a) * t, b + (d - b) * t)), k, t))
        out[i] = (best[1], best[2], best[0])
    return out


@pytest.mark.parametrize(("kind", "limits"), [("weights", {"walking": 250.0}), ("axmeter", {"walking": 220.0, "straight": 170.0})])
def test_attractions_to_lines_junctions_and_points(spark, kind, limits):
    lines, g, plain = network(spark, 20 + len(limits))
    weight = {i: 1.0 + i % 4 for i in range(len(lines))}
    heavy = {**g, "lines": g["lines"].withColumn("w", 1.0 + g["lines"].line_id % 4)}
    attractions = [(0, 30.0, 20.0), (1, 150.0, 180.0), (2, 150.0, 180.0), (3, 20.0, 21.0)]
    spots = [(10, 40.0, 30.0), (11, 210.0, 90.0), (12, 35.0, 22.0), (13, 100.0, 101.0)]
    shape = "pt_id long, x double, y double"
    a, p = spark.createDataFrame(attractions, shape), spark.createDataFrame(spots, shape)
    from_, to = places(attractions, lines), places(spots, lines)
    walks = {i: list(plain.walk(k, t, limits, next((x, y) for j, x, y in attractions if j == i), d, weight)) for i, (k, t, d) in from_.items()}
    options = {"weight": "w"} if kind == "weights" else {}
    get = lambda targets: {r.target if not isinstance(targets, str) else (round(r.target.x, 6), round(r.target.y, 6)): r.distance for r in multidistance.attraction_distance(heavy, a, kind, Radius(**limits), targets, **options).collect()}
    crossings = {}
    for c in plain.on:
        x, y = map(float, c.split(","))
        crossings[round(x, 6), round(y, 6)] = min((v[kind] for w in walks.values() for k, d, _, v in w if k == "crossing" and d == c), default=-1.0)
    assert get("junctions") == pytest.approx(crossings, abs=1e-4)
    if kind == "weights":
        return
    flat = {i: [x for x in w if x[0] != "crossing"] for i, w in walks.items()}
    known = lambda v: v if v < math.inf else -1.0
    assert get(None) == pytest.approx({i: known(min(plain.least(w, (i, 0.5, 0.0), limits, kind) for w in flat.values())) for i in range(len(lines))}, abs=1e-4)
    near = lambda i, j: math.dist(attractions[i][1:], next((x, y) for k, x, y in spots if k == j)) <= limits.get("straight", math.inf)
    pairs = {(i, j): plain.least(flat[i], to[j], limits, kind, True) if near(i, j) else math.inf for i in flat for j in to}
    assert get(p) == pytest.approx({j: known(min(pairs[i, j] for i in flat)) for j in to}, abs=1e-4)
    values = {0: 4.0, 1: 2.0, 2: 3.0, 3: -1.0}
    scores = multidistance.attraction_reach(heavy, spark.createDataFrame([(*r, values[r[0]]) for r in attractions], shape + ", value double"), kind, Radius(**limits), "divide", 0.5, p)
    want = {j: sum(v * (pairs[i, j] + 1) ** -0.5 for i, v in values.items() if v > 0 and pairs[i, j] < math.inf) for j in to}
    assert {r.target: r.score for r in scores.collect()} == pytest.approx(want, abs=1e-6)


def test_polygons_and_groups(spark):
    g = axial.graph(frame(spark, chain(5, 10)))
    ring = "region_id long, ring array<struct<x:double,y:double>>, value double"
    regions = spark.createDataFrame([(7, [(1.0, 1.0), (21.0, 1.0), (21.0, 2.0), (1.0, 2.0)], 8.0), (8, [(40.0, 1.0), (41.0, 1.0), (41.0, 2.0)], 5.0), (9, [], 3.0)], ring)
    copied, shared = multidistance.polygon_attractions(regions, 10.0), multidistance.polygon_attractions(regions, 10.0, "divide")
    assert sorted((r.owner, r.value) for r in copied.collect()) == [(7, 8.0)] * 5 + [(8, 5.0)]
    assert sorted(r.value for r in shared.collect()) == [1.6] * 5 + [5.0]
    lines = lambda d: by_line(d.withColumnRenamed("target", "line_id"), "score")
    assert lines(multidistance.attraction_reach(g, copied, "steps", Radius(steps=1), "divide", 1.0)) == [8.0, 8.0, 8.0 + 2.5, 4.0 + 5.0, 2.5]
    nearest = {r.pt_id: min(int(r.x // 10), 3) for r in shared.collect()}
    value = {r.pt_id: r.value for r in shared.collect()}
    want = [sum(v for k, v in value.items() if abs(nearest[k] - i) <= 1) for i in range(5)]
    assert lines(multidistance.attraction_reach(g, shared, "steps", Radius(steps=1))) == pytest.approx(want)
    points = spark.createDataFrame([(0, 5.0, 0.0, 1), (1, 25.0, 0.0, 1), (2, 45.0, 0.0, 2), (3, 45.0, 0.0, 2)], "pt_id long, x double, y double, group_id long")
    one = spark.createDataFrame([(0, -1.0, 0.0)], "pt_id long, x double, y double")
    far = multidistance.attraction_distance(g, one, "walking", Radius(walking=30.0), points)
    group = lambda how: {r.group_id: r.distance for r in multidistance.by_group(far, points, "distance", how).collect()}
    assert group("min") == {1: 6.0, 2: -1.0} and group("max") == {1: 26.0, 2: -1.0} and group("avg") == {1: 16.0, 2: -1.0} and group("sum") == {1: 32.0, 2: -1.0}
    with pytest.raises(ValueError, match="no distribution"):
        multidistance.polygon_attractions(regions, 1.0, "half")


def test_nothing_and_limits_unknown(spark):
    g = axial.graph(frame(spark, square(3)))
    none = spark.createDataFrame([], "pt_id long, x double, y double")
    assert {r.distance for r in multidistance.attraction_distance(g, none, "angular").collect()} == {-1.0}
    empty = axial.graph(frame(spark, square(3)).limit(0))
    assert reach.reach(empty, Radius(walking=3.0, steps=1)).count() == 0
    with pytest.raises(ValueError, match="no paths by feet"):
        multidistance.reached(g, multidistance.from_lines(g), "feet", Radius())
    with pytest.raises(ValueError, match="takes no limit by straight"):
        reach.segment_depths(frame(spark, square(3)), Radius(straight=1.0))
