import itertools
import math
import random

import pytest
from networks import CROSSHAIR, SPLIT, SPLIT2, by_line, chain, frame, square

from urbangraph.lineage import cut
from urbangraph.operators import axial, frontier, grouping, paths, reach
from urbangraph.radii import Radius

near = lambda x: pytest.approx(x, rel=1e-3, abs=1e-3)


def test_reach(spark):
    g = axial.graph(frame(spark, chain(3, 3)))
    for radius, count in ((Radius(), [3, 3, 3]), (Radius(straight=3), [2, 3, 2]), (Radius(walking=3), [2, 3, 2]), (Radius(steps=1), [2, 3, 2]), (Radius(angular=1), [3, 3, 3])):
        assert by_line(reach.reach(g, radius), "reach_count") == count, radius
    g = axial.graph(frame(spark, square(3)))
    for limit, count, area in ((80, 1, 0), (100, 3, 9), (190, 4, 9)):
        out = reach.reach(g, Radius(angular=limit)).orderBy("line_id").collect()
        assert [(r.reach_count, r.reach_length, r.reach_area) for r in out] == [(count, near(3 * count), near(area))] * 4, limit


def test_network_integration(spark):
    out = reach.network_integration(axial.graph(frame(spark, chain(5, 3))))
    assert by_line(out, "total_depth") == [10, 7, 6, 7, 10]
    assert by_line(out, "integration") == near([0.352, 0.704, 1.056, 0.704, 0.352])
    g = axial.graph(frame(spark, chain(5, 3)))
    assert by_line(reach.network_integration(g, Radius(walking=3)), "node_count") == [2, 3, 3, 3, 2]
    assert by_line(reach.network_integration(g, Radius(steps=2)), "node_count") == [3, 4, 5, 4, 3]


def test_angular_integration(spark):
    lines = frame(spark, square(3))
    assert by_line(paths.angular_integration(lines), "total_depth") == near([4] * 4)
    assert by_line(paths.angular_integration(lines), "total_depth_weight") == near([12] * 4)
    assert by_line(paths.angular_integration(lines, Radius(angular=80)), "node_count") == [1] * 4
    assert by_line(paths.angular_integration(lines, Radius(angular=100)), "node_count") == [3] * 4


def test_angular_choice(spark):
    lines = frame(spark, chain(5, 3))
    assert by_line(paths.angular_choice(lines), "choice") == near([0, 6, 8, 6, 0])
    assert by_line(paths.angular_choice(lines, by_length=True), "choice") == near([36, 90, 108, 90, 36])
    box = frame(spark, square(3))
    assert by_line(paths.angular_choice(box), "choice") == near([1] * 4)
    assert by_line(paths.angular_choice(box), "total_depth") == near([4] * 4)
    assert by_line(paths.angular_choice(box, by_length=True), "choice") == near([36] * 4)


def test_segment_betweenness(spark):
    assert by_line(paths.segment_betweenness(frame(spark, chain(5, 1)), "steps", Radius(steps=4)), "betweenness") == near([0, 3, 4, 3, 0])
    assert by_line(paths.segment_betweenness(frame(spark, SPLIT), "angular", Radius(angular=45)), "betweenness") == near([0, 1.5, 1.5, 1.5, 1.5, 0])
    assert by_line(paths.segment_betweenness(frame(spark, SPLIT2), "angular", Radius(angular=45)), "betweenness") == near([0, 1, 1, 2, 2, 0])


def test_angular_betweenness(spark):
    assert by_line(paths.angular_betweenness(frame(spark, chain(5, 3)), by_length=True), "betweenness") == near([0, 27, 36, 27, 0])
    out = paths.angular_betweenness(frame(spark, SPLIT))
    assert by_line(out, "betweenness") == near([0, 2, 2, 2, 2, 0])
    assert by_line(out, "total_depth") == pytest.approx([0.77, 4.26, 4.26, 4.26, 4.26, 0.77], abs=0.02)
    assert by_line(paths.angular_betweenness(frame(spark, SPLIT2)), "betweenness") == near([0, 1, 1, 3, 3, 0])


def crooked(seed, n=4):
    """A grid of streets with moved corners, some diagonals and some gaps."""
    rng = random.Random(seed)
    at = {(i, j): (100.0 * i + rng.randint(-30, 30), 100.0 * j + rng.randint(-30, 30)) for i in range(n) for j in range(n)}
    ways = [((i, j), (i + a, j + b)) for i, j in at for a, b in ((1, 0), (0, 1), (1, 1)) if (i + a, j + b) in at and rng.random() < (0.9 if a + b == 1 else 0.3)]
    return [(*at[p], *at[q]) if rng.random() < 0.5 else (*at[q], *at[p]) for p, q in ways]


def moves(lines):
    """{(line, forward): [(line, forward, turn, walk, point)]}, lengths and middles."""
    length = [math.dist(x[:2], x[2:]) for x in lines]
    middle = [((a + c) / 2, (b + d) / 2) for a, b, c, d in lines]
    way = lambda i, f: math.degrees(math.atan2(lines[i][3] - lines[i][1], lines[i][2] - lines[i][0])) + 180 * (not f)
    out = {}
    for i, f in itertools.product(range(len(lines)), (0, 1)):
        end = lines[i][2:] if f else lines[i][:2]
        turn = lambda j, g, i=i, f=f: 180 - abs(abs(way(i, f) - way(j, g)) % 360 - 180)
        out[i, f] = [(j, g, turn(j, g), (length[i] + length[j]) / 2, end) for j, g in itertools.product(range(len(lines)), (0, 1)) if j != i and (lines[j][:2] if g else lines[j][2:]) == end]
    return out, length, middle


def plain_betweenness(lines, kind, limits):
    """Betweenness by settling one entry at a time from a list, and by walking back all least paths."""
    near, length, middle = moves(lines)
    score, counts = [0.0] * len(lines), []
    both = kind == "angular"
    for o in range(len(lines)):
        name = (lambda s: s) if both else (lambda s: s[0])
        far = lambda i, o=o: math.dist(middle[i], middle[o])
        entries, dist, paths, begin = [], {}, {}, [name((o, 0)), name((o, 1))]

        def extend(s, cost, so_far, path, entries=entries, dist=dist, o=o, far=far, name=name):
            for j, g, turn, walk, _ in near[s]:
                new = {"angular": so_far["angular"] + turn, "steps": so_far["steps"] + 1, "walking": so_far["walking"] + walk}
                new["axmeter"] = so_far["axmeter"] + (length[s[0]] * new["steps"] + length[j] * (new["steps"] + 1)) / 2
                if j != o and name((j, g)) not in dist and all(new[k] <= v for k, v in limits.items() if k != "straight") and far(j) <= limits.get("straight", math.inf):
                    entries.append((cost + round((new[kind] - so_far[kind]) * 1e6), len(entries), (j, g), new, path))

        for b in begin:
            dist[b], paths[b] = 0, [[b]]
        for f in (0, 1):
            extend((o, f), 0, dict.fromkeys(("angular", "steps", "walking", "axmeter"), 0.0), name((o, f)))
        open_ = set(range(len(entries)))
        while open_:
            k = min(open_, key=lambda k: entries[k][:2])
            open_.remove(k)
            cost, _, s, so_far, came = entries[k]
            n = name(s)
            if n not in dist:
                dist[n], paths[n], before = cost, [], len(entries)
                extend(s, cost, so_far, n)
                open_ |= set(range(before, len(entries)))
            if cost == dist[n]:
                paths[n] += [[*p, n] for p in paths[came]]
        reached = {}
        for n in dist:
            i = n[0] if both else n
            reached[i] = min(reached.get(i, math.inf), dist[n])
        for i, best in reached.items():
            ends = [n for n in dist if (n[0] if both else n) == i and dist[n] <= best]
            for n in ends if i != o else []:
                for p in paths[n]:
                    for x in p[1:-1]:
                        score[x[0] if both else x] += 0.5 / len(paths[n])
        counts.append((len(reached), sum(reached.values()) / 1e6))
    return score, counts


LIMITS = [{}, {"walking": 250.0}, {"walking": 320.0, "steps": 3}, {"angular": 130.0, "walking": 300.0}, {"axmeter": 600.0, "straight": 220.0}, {"straight": 200.0, "steps": 4, "angular": 200.0}]


@pytest.mark.parametrize("limits", LIMITS)
def test_betweenness_with_several_limits(spark, monkeypatch, limits):
    monkeypatch.setattr(paths, "ORIGINS", 5)
    made = crooked(len(limits))
    lines = frame(spark, made)
    for kind in paths.KINDS:
        score, counts = plain_betweenness(made, kind, limits)
        out = paths.segment_betweenness(lines, kind, Radius(**limits), tile=150.0).orderBy("line_id").collect()
        assert [r.betweenness for r in out] == pytest.approx(score, abs=1e-6), kind
        assert [(r.node_count, r.total_depth * (90 if kind == "angular" else 1)) for r in out] == [(n, pytest.approx(d, abs=1e-4)) for n, d in counts], kind


def plain_reached(lines, limits):
    """Of each line the numbers of lines reached and the sum of their turns, entries of least whole degrees first."""
    near, _, middle = moves(lines)
    out = []
    for o in range(len(lines)):
        far = lambda p, o=o: math.dist(p, middle[o]) <= limits.get("straight", math.inf)
        entries, key, turns = [(0, 0, (o, 0), 0.0, 0.0, 0), (0, 1, (o, 1), 0.0, 0.0, 0)], {}, {}
        open_ = {0, 1}
        while open_:
            k = min(open_, key=lambda k: entries[k][:2])
            open_.remove(k)
            cost, _, s, turned, walked, steps = entries[k]
            if s in key:
                continue
            key[s] = cost
            turns.setdefault(s[0], turned)
            for j, g, turn, walk, point in near[s] if steps < limits.get("steps", math.inf) else []:
                if far(point) and far(middle[j]) and walked + walk <= limits.get("walking", math.inf) and turned + turn <= limits.get("angular", math.inf):
                    open_.add(len(entries))
                    entries.append((cost + int(turn + 0.5), len(entries), (j, g), turned + turn, walked + walk, steps + 1))
        out.append((len(turns), pytest.approx(sum(turns.values()) / 90, abs=1e-6)))
    return out


@pytest.mark.parametrize("limits", [x for x in LIMITS if "axmeter" not in x])
def test_choice_with_several_limits(spark, monkeypatch, limits):
    monkeypatch.setattr(paths, "ORIGINS", 5)
    made = crooked(10 + len(limits))
    lines = frame(spark, made)
    out = paths.angular_choice(lines, Radius(**limits), tile=150.0).orderBy("line_id").collect()
    assert [(r.node_count, r.total_depth) for r in out] == plain_reached(made, limits)
    monkeypatch.setattr(paths, "ORIGINS", 1000)
    assert [r.choice for r in out] == pytest.approx(by_line(paths.angular_choice(lines, Radius(**limits), tile=1e6), "choice"))


def test_limits_that_a_measure_does_not_apply(spark):
    lines = frame(spark, chain(3, 3))
    with pytest.raises(ValueError, match="angular choice takes no limit by axmeter"):
        paths.angular_choice(lines, Radius(axmeter=1.0))
    with pytest.raises(ValueError, match="no betweenness by straight"):
        paths.segment_betweenness(lines, "straight")


def test_paths_of_nothing(spark):
    none = frame(spark, [(0, 0, 1, 1)]).limit(0)
    for out in (paths.angular_choice(none), paths.segment_betweenness(none, "steps"), paths.angular_betweenness(none), paths.angular_choice(none, Radius(walking=5.0))):
        assert out.count() == 0


def test_groups_of_origins_agree_with_the_whole(spark, monkeypatch):
    lines = frame(spark, crooked(3, 5))
    measures = [lambda: paths.angular_choice(lines), lambda: paths.segment_betweenness(lines, "angular", weight="length"), lambda: paths.segment_betweenness(lines, "walking"), lambda: paths.angular_betweenness(lines, True)]
    rows = lambda df: [tuple(r) for r in df.orderBy("line_id").collect()]
    whole = [rows(m()) for m in measures]
    monkeypatch.setattr(paths, "ORIGINS", 4)
    dealt = paths.groups(lines, None, 2000.0)
    assert dealt.select("part").distinct().count() > 5 and dealt.where("own").count() == lines.count()
    for m, w in zip(measures, whole, strict=True):
        assert rows(m()) == [tuple(pytest.approx(x) for x in r) for r in w]


def test_tiles_agree_with_the_whole(spark):
    grid = [(100 * i, 100 * j, 100 * (i + 1), 100 * j) for i in range(6) for j in range(6)] + [(100 * i, 100 * j, 100 * i, 100 * (j + 1)) for i in range(6) for j in range(6)]
    lines = frame(spark, grid)
    for f in (lambda t: paths.angular_choice(lines, Radius(walking=250), tile=t), lambda t: paths.segment_betweenness(lines, "angular", Radius(walking=250), tile=t).withColumnRenamed("betweenness", "choice")):
        assert by_line(f(150.0), "choice") == near(by_line(f(1e6), "choice"))


def test_od_betweenness(spark):
    lines = frame(spark, chain(3, 1))
    point = "pt_id long, x double, y double, weight double"
    origin, ends = spark.createDataFrame([(0, -0.5, 0.0, 1.0)], point), spark.createDataFrame([(0, 1.5, 0.5, 1.0), (1, 3.5, 0.0, 1.0)], point)
    for options, scores in (({"closest": True}, [1, 1, 0]), ({}, [1, 1, 0.5]), ({"walking": 3.9}, [1, 1, 0]), ({"walking": 4.1}, [1, 1, 0.5])):
        assert by_line(paths.od_betweenness(lines, origin, ends, **options), "score") == near(scores), options
    ten, uneven = spark.createDataFrame([(0, -0.5, 0.0, 10.0)], point), spark.createDataFrame([(0, 1.5, 0.5, 4.0), (1, 3.5, 0.0, 1.0)], point)
    assert by_line(paths.od_betweenness(lines, ten, uneven), "score") == near([10, 10, 2])


def test_attractions(spark):
    lines = frame(spark, chain(5, 3))
    g = axial.graph(lines)
    one = spark.createDataFrame([(0, -1.0, 0.0, 4.0)], "pt_id long, x double, y double, value double")
    assert by_line(reach.attraction_distance(g, one, "walking"), "distance") == near([2.5, 5.5, 8.5, 11.5, 14.5])
    assert by_line(reach.attraction_distance(g, one, "steps", 3), "distance") == near([0, 1, 2, 3, -1])
    two = spark.createDataFrame([(0, -1.0, 0.0, 4.0), (1, 16.0, 0.0, 3.0)], "pt_id long, x double, y double, value double")
    assert by_line(reach.attraction_reach(g, two, "walking"), "score") == near([7] * 5)
    assert by_line(reach.attraction_reach(g, two, "steps", 2), "score") == near([4, 4, 7, 3, 3])
    assert by_line(reach.attraction_reach(g, two, "steps", 2, "divide", 1.0), "score") == near([4, 2, 4 / 3 + 1, 1.5, 3])


def test_grouping_and_group_integration(spark):
    for lines, threshold, split, groups in (
        (square(1), 89, False, [0, 1, 2, 3]), (square(1), 90, False, [0] * 4), (CROSSHAIR, 89, False, [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]), (CROSSHAIR, 89, True, list(range(12))), (CROSSHAIR, 90, False, [0] * 8 + [1, 1, 2, 2]),
        ([(0, 0, -1, 0), (-1, 0.01, 0, 0)], 100, False, [0, 1]), ([(0, 0, -1, 0), (-1, 0.01, 0, 0)], 180, False, [0, 0]), ([(0, 0, -1, 0), (-1, 0.01, 0, 0), (0, 0, 1, 1)], 90, False, [0, 1, 0]),
    ):
        assert by_line(grouping.grouping(frame(spark, lines), threshold, split), "group_id") == groups, (threshold, split)
    lines = frame(spark, CROSSHAIR)
    assert by_line(grouping.group_colours(lines, grouping.grouping(lines, 89)), "colour") == [0, 0, 1, 1, 0, 0, 1, 1, 0, 0, 1, 1]
    assert by_line(grouping.group_colours(lines, grouping.grouping(lines, 89, True)), "colour") == [0, 1, 2, 1, 0, 1, 0, 2, 0, 1, 2, 3]
    of = spark.createDataFrame(list(enumerate([0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 7])), "line_id long, group_id long")
    assert by_line(grouping.group_integration(lines, of), "total_depth", "group_id") == [11] * 4 + [10] * 4
    assert by_line(grouping.group_integration(lines, of, Radius(steps=1)), "node_count", "group_id") == [4] * 4 + [5] * 4
    assert by_line(grouping.group_integration(lines, of, Radius(walking=1)), "node_count", "group_id") == [7] * 4 + [8] * 4


def test_group_integration_goes_from_group_to_group(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(frontier, "cut", lambda df: rounds.append(1) or cut(df))
    lines = chain(12, 1) + [(6, 0, 6, 1), (6, 1, 5, 1)]
    of = spark.createDataFrame(list(enumerate([0] * 12 + [1, 2])), "line_id long, group_id long")
    assert by_line(grouping.group_integration(frame(spark, lines), of, connected=True), "total_depth", "group_id") == [3, 2, 3]
    assert len(rounds) <= 6  # the changes of group count, not the lines of a street


def test_group_integration_against_all_ends(spark):
    rng = random.Random(3)
    lines = [(a % 4, a // 4, b % 4, b // 4) for a, b in ((rng.randrange(16), rng.randrange(16)) for _ in range(14))]
    of = [rng.randrange(6) for _ in lines]  # lines of a group may lie apart
    expected = {}
    for origin in sorted(set(of)):
        d = {(i, e): 0 for i, g in enumerate(of) if g == origin for e in (0, 1)}
        todo = list(d)
        while todo:
            i, e = todo.pop(0)
            for j, f in [(i, 1 - e), *((j, f) for j in range(len(lines)) for f in (0, 1) if lines[j][2 * f : 2 * f + 2] == lines[i][2 * e : 2 * e + 2])]:
                cost = d[i, e] + (of[i] != of[j])
                if cost < d.get((j, f), 99) and cost <= 2:
                    d[j, f] = cost
                    todo.append((j, f))
        least = {g: min(c for (i, _), c in d.items() if of[i] == g) for g in {of[i] for i, _ in d}}
        expected[origin] = (len(least), sum(least.values()))
    out = grouping.group_integration(frame(spark, lines), spark.createDataFrame(list(enumerate(of)), "line_id long, group_id long"), Radius(steps=2))
    assert {r["group_id"]: (r["node_count"], r["total_depth"]) for r in out.collect()} == expected


def test_od_by_turns_against_all_walks(spark):
    made = crooked(31, 4)
    near, length, _ = moves(made)
    rng = random.Random(8)
    on = lambda i, t: (made[i][0] + (made[i][2] - made[i][0]) * t, made[i][1] + (made[i][3] - made[i][1]) * t)
    starts = [(k, i, t) for k in range(5) for i, t in [(rng.randrange(len(made)), rng.uniform(0.2, 0.8))]]
    ends = [(k, i, t, float(k % 3)) for k in range(9) for i, t in [(rng.randrange(len(made)), rng.uniform(0.2, 0.8))]]
    score = [0.0] * len(made)
    for _, o, t in starts:
        best = {}
        todo = [(o, f, 0.0, [o]) for f in (0, 1)]
        while todo:
            i, f, turned, path = todo.pop()
            for k, j, u, w in ends:
                ahead = i == j and (len(path) > 1 or (u > t) == bool(f))
                if w > 0 and ahead and turned < best.get(k, (math.inf,))[0]:
                    best[k] = (turned, path, w)
            if len(path) < 5:
                todo += [(j, g, turned + a, [*path, j]) for j, g, a, _, _ in near[i, f] if turned + a <= 130.0 and j not in path]
        for _, path, w in best.values():
            for i in path:
                score[i] += w / sum(x[2] for x in best.values())
    origins = spark.createDataFrame([(k, *on(i, t)) for k, i, t in starts], "pt_id long, x double, y double")
    targets = spark.createDataFrame([(k, *on(i, t), w) for k, i, t, w in ends], "pt_id long, x double, y double, weight double")
    out = paths.od_betweenness(frame(spark, made), origins, targets, kind="angular", radius=Radius(angular=130.0, steps=4))
    assert by_line(out, "score") == pytest.approx(score, abs=1e-6)
    assert max(by_line(paths.od_betweenness(frame(spark, made), origins, targets.drop("weight"), kind="walking", radius=Radius(straight=1.0)), "score")) <= 5.0
    with pytest.raises(ValueError, match="no flows by steps"):
        paths.od_betweenness(frame(spark, made), origins, targets, kind="steps")
