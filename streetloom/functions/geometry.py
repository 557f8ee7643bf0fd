"""Geometry as columns: lines and rings are arrays of ``struct<x, y>``, polygons arrays of closed rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """An axis-parallel rectangle as a polygon."""
    corners = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    return F.array(F.array(*(point(x, y) for x, y in corners)))


def _sides(line: Column) -> Column:
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, s: acc + value(s))


def _cross(s: Column) -> Column:
    return s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def length(line: Column) -> Column:
    return _total(_sides(line), lambda s: hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def _moments(ring: Column) -> Column:
    """``struct<w, x, y>`` over the sides of a ring, in one pass: twice its signed area, and its moments times six."""
    d = F.lit(0.0)
    begin = F.struct(F.get(ring, F.lit(0))["x"].alias("px"), F.get(ring, F.lit(0))["y"].alias("py"), d.alias("w"), d.alias("x"), d.alias("y"))

    def step(s: Column, p: Column) -> Column:
        cross = s["px"] * p["y"] - p["x"] * s["py"]
        return F.struct(p["x"].alias("px"), p["y"].alias("py"), (s["w"] + cross).alias("w"), (s["x"] + (s["px"] + p["x"]) * cross).alias("x"), (s["y"] + (s["py"] + p["y"]) * cross).alias("y"))

    return F.aggregate(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), begin, step)


def ring_area(ring: Column) -> Column:
    return F.abs(_moments(ring)["w"]) / 2


def area(polygon: Column) -> Column:
    """Area of the outer ring less that of the holes."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return ring_area(F.get(polygon, F.lit(0))) - _total(holes, ring_area)


def perimeter(polygon: Column) -> Column:
    """Length of all rings."""
    return _total(polygon, length)


def centroid(polygon: Column) -> Column:
    """Centroid of the outer ring."""

    def of(m: Column) -> Column:
        return F.struct(F.try_divide(m["x"], 3 * m["w"]).alias("x"), F.try_divide(m["y"], 3 * m["w"]).alias("y"))

    # A lambda's variable is computed once, a column that is used four times four times.
    return F.get(F.transform(F.array(_moments(F.get(polygon, F.lit(0)))), of), F.lit(0))


def bounds(line: Column) -> Column:
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def is_rectangle(polygon: Column) -> Column:
    """Five points, opposite sides of equal length, four exact right angles."""
    sides = _sides(F.get(polygon, F.lit(0)))
    squared = F.transform(sides, lambda s: (s["b"]["x"] - s["a"]["x"]) ** 2 + (s["b"]["y"] - s["a"]["y"]) ** 2)
    after = F.concat(F.slice(sides, 2, 3), F.slice(sides, 1, 1))
    dots = F.zip_with(sides, after, lambda s, t: (s["b"]["x"] - s["a"]["x"]) * (t["b"]["x"] - t["a"]["x"]) + (s["b"]["y"] - s["a"]["y"]) * (t["b"]["y"] - t["a"]["y"]))
    equal = (F.get(squared, F.lit(0)) == F.get(squared, F.lit(2))) & (F.get(squared, F.lit(1)) == F.get(squared, F.lit(3)))
    return F.when(F.size(sides) == 4, equal & F.forall(dots, lambda d: d == 0)).otherwise(False)


def squareness(polygon: Column) -> Column:
    """Mean deviation of the outer ring's corners from 90 degrees."""
    ring = F.get(polygon, F.lit(0))
    sides = _sides(ring)
    n = F.size(sides)
    after = F.concat(F.slice(sides, 2, F.greatest(n - 1, F.lit(0))), F.slice(sides, 1, 1))

    def corner(s: Column, t: Column) -> Column:
        ax, ay = s["a"]["x"] - s["b"]["x"], s["a"]["y"] - s["b"]["y"]
        bx, by = t["b"]["x"] - t["a"]["x"], t["b"]["y"] - t["a"]["y"]
        cosine = F.try_divide(ax * bx + ay * by, hypot(ax, ay) * hypot(bx, by))
        return F.abs(90 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))

    angles = F.zip_with(sides, after, corner)
    return F.try_divide(_total(angles, lambda a: a), n)


def segment_distance_squared(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point to a segment (which may be a point)."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = ax + t * dx - px, ay + t * dy - py
    return ex * ex + ey * ey


def side_of(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Sign of the turn from a-b to p."""
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_cross(a: list[Column], b: list[Column]) -> Column:
    """Whether the insides of two segments ``[x1, y1, x2, y2]`` meet in one point."""
    s1, s2 = side_of(*a, b[0], b[1]), side_of(*a, b[2], b[3])
    s3, s4 = side_of(*b, a[0], a[1]), side_of(*b, a[2], a[3])
    return (s1 * s2 < 0) & (s3 * s4 < 0)


def segment_gap(a: list[Column], b: list[Column]) -> Column:
    """Distance of two segments; zero if they cross."""
    ends = [
        segment_distance_squared(a[0], a[1], *b), segment_distance_squared(a[2], a[3], *b),
        segment_distance_squared(b[0], b[1], *a), segment_distance_squared(b[2], b[3], *a),
    ]
    return F.when(segments_cross(a, b), 0.0).otherwise(F.sqrt(F.least(*ends)))
