"""Small networks: lines as (x1, y1, x2, y2)."""


def frame(spark, lines):
    return spark.createDataFrame([(i, *map(float, xy)) for i, xy in enumerate(lines)], "line_id long, x1 double, y1 double, x2 double, y2 double")


def chain(n, length):
    return [(i * length, 0, (i + 1) * length, 0) for i in range(n)]


def polygon(points, pairs):
    return [(*points[a], *points[b]) for a, b in pairs]


def square(length):
    return polygon([(0, 0), (length, 0), (length, length), (0, length)], [(0, 1), (1, 2), (2, 3), (3, 0)])


CROSSHAIR = polygon(
    [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (0, 0)],
    [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 0), (3, 8), (8, 7), (1, 8), (8, 5)],
)
SPLIT = polygon([(-2, 0), (-1, 0), (0, 0.1), (0, -0.1), (1, 0), (2, 0)], [(0, 1), (1, 2), (2, 4), (1, 3), (3, 4), (4, 5)])
SPLIT2 = polygon([(-2, 0), (-1, 0), (0, 0.1), (0, 0), (1, 0), (2, 0)], [(0, 1), (1, 2), (2, 4), (1, 3), (3, 4), (4, 5)])


def by_line(df, column, key="line_id"):
    return [r[column] for r in df.orderBy(key).collect()]
