"""Spatial joins by grid cells: explode boxes to cells, equi-join on the cell, test exactly.

A cell of about the size of the features (or of the search radius) keeps the
candidates of a cell few, and AQE splits a cell that is crowded all the same.
Pairs that meet in several cells are kept only in the cell of the lower left
corner of their common box, so no distinct is needed. ``by`` names columns
(such as the city) that both sides must share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetloom.functions.geometry import hypot, segment_distance_squared
from streetloom.plans.shared import materialise


_ENDS = ("x1", "y1", "x2", "y2")


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def _prefixed(df: DataFrame, prefix: str, by: list[str]) -> DataFrame:
    return df.select(*by, *(F.col(f"`{c}`").alias(prefix + c) for c in df.columns if c not in by))


def _in_cells(df: DataFrame, prefix: str, size: float, margin: float = 0.0) -> DataFrame:
    """A row for each cell that the row's box (grown by ``margin``) touches."""
    lo, hi = (lambda c: F.col(prefix + c) - margin), (lambda c: F.col(prefix + c) + margin)
    xs = F.sequence(_cell(lo("minx"), size), _cell(hi("maxx"), size))
    ys = F.sequence(_cell(lo("miny"), size), _cell(hi("maxy"), size))
    return df.withColumn("__cx", F.explode(xs)).withColumn("__cy", F.explode(ys))


def box_join(left: DataFrame, right: DataFrame, cell: float, condition: Column | None = None, by: list[str] = (), margin: float = 0.0) -> DataFrame:
    """Pairs whose boxes (``minx, miny, maxx, maxy``) meet, the left one grown by ``margin``.

    Columns come back with ``l_`` and ``r_`` in front; ``condition`` is the
    exact test over them.
    """
    by = list(by)
    a = _in_cells(_prefixed(left, "l_", by), "l_", cell, margin)
    b = _in_cells(_prefixed(right, "r_", by), "r_", cell)
    meet = (
        (F.col("l_minx") - margin <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("l_maxx") + margin)
        & (F.col("l_miny") - margin <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("l_maxy") + margin)
    )
    home = (F.col("__cx") == _cell(F.greatest(F.col("l_minx") - margin, "r_minx"), cell)) & (F.col("__cy") == _cell(F.greatest(F.col("l_miny") - margin, "r_miny"), cell))
    pairs = a.join(b, [*by, "__cx", "__cy"]).where(meet & home)
    return (pairs if condition is None else pairs.where(condition)).drop("__cx", "__cy")


def radius_join(left: DataFrame, right: DataFrame, radius: float, by: list[str] = ()) -> DataFrame:
    """Pairs of points (``x, y``) at most ``radius`` apart, with ``l_``/``r_`` columns and ``distance``."""
    by = list(by)
    near = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
    a = _prefixed(left, "l_", by).withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near))
    a = a.withColumns({"__cx": _cell(F.col("l_x"), radius) + F.col("__dx"), "__cy": _cell(F.col("l_y"), radius) + F.col("__dy")}).drop("__dx", "__dy")
    b = _prefixed(right, "r_", by).withColumns({"__cx": _cell(F.col("r_x"), radius), "__cy": _cell(F.col("r_y"), radius)})
    dx, dy = F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y")
    return a.join(b, [*by, "__cx", "__cy"]).where(dx * dx + dy * dy <= radius * radius).withColumn("distance", F.sqrt(dx * dx + dy * dy)).drop("__cx", "__cy")


def nearest_segment(points: DataFrame, segments: DataFrame, most: float, point_id: str, segment_id: str, by: list[str] = (), first: float | None = None) -> DataFrame:
    """For each point the nearest segment (``x1, y1, x2, y2``) within ``most``, of several the least id.

    ``by, point_id, segment_id, distance``; points without one are left out.
    Points look within ``first`` (an eighth of ``most``), and those that found
    nothing look four times as far: whatever is found within a radius is
    nearer than all beyond it, so most points test few segments.
    """
    by, keys = list(by), [*by, point_id]
    todo = points.select(*keys, "x", "y")
    lines = segments.select(*by, F.col(segment_id).alias("__id"), *_ENDS)
    d2 = segment_distance_squared(*(F.col(c) for c in ("x", "y", *_ENDS)))
    radius, out = min(first or most / 8, most), None
    while True:
        # A point lies in one cell, so pairs need no distinct, and are grouped where the join left them.
        cell = 3 * radius
        spans = [F.sequence(_cell(F.least(a, b) - radius, cell), _cell(F.greatest(a, b) + radius, cell)) for a, b in (("x1", "x2"), ("y1", "y2"))]
        near = lines.withColumn("__cx", F.explode(spans[0])).withColumn("__cy", F.explode(spans[1]))
        pairs = todo.withColumns({"__cx": _cell(F.col("x"), cell), "__cy": _cell(F.col("y"), cell)}).join(near, [*by, "__cx", "__cy"])
        pairs = pairs.select(*keys, "__cx", "__cy", "__id", d2.alias("__d2")).where(F.col("__d2") <= radius * radius)
        found = pairs.groupBy(*keys, "__cx", "__cy").agg(F.min(F.struct("__d2", "__id")).alias("b")).select(*keys, F.col("b.__id").alias(segment_id), F.sqrt("b.__d2").alias("distance"))
        if radius >= most:
            return found if out is None else out.unionByName(found)
        found = materialise(found)  # read twice
        out = found if out is None else out.unionByName(found)
        todo, radius = todo.join(found.select(*keys), keys, "left_anti"), min(4 * radius, most)


def nearest_neighbours(points: DataFrame, k: int, key: str, start: float, by: list[str] = (), most_rounds: int = 40) -> DataFrame:
    """The ``k`` nearest other points of each point, of equally near ones those of least key.

    ``by, key, neighbour, distance, rank``. Points search a radius that doubles
    until it holds ``k`` others (or all there are); only unfinished points go
    on. All rows within the final radius are seen, so the result is exact.
    """
    by = list(by)
    slim = points.select(*by, key, "x", "y")
    sizes = slim.groupBy(*by).agg(F.count("*").alias("__all")) if by else slim.agg(F.count("*").alias("__all"))
    todo = slim.join(sizes, by) if by else slim.join(F.broadcast(sizes))
    todo, out, radius = materialise(todo), None, start
    order = Window.partitionBy(*by, "l_" + key).orderBy("distance", "r_" + key)
    for _ in range(most_rounds):
        pairs = radius_join(todo, slim, radius, by).where(F.col("l_" + key) != F.col("r_" + key))
        found = pairs.groupBy(*by, "l_" + key).agg(F.count("*").alias("__n"), F.first("l___all").alias("__of"))
        full = found.where((F.col("__n") >= k) | (F.col("__n") >= F.col("__of") - 1)).select(*by, "l_" + key)
        ranked = pairs.join(full, [*by, "l_" + key], "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = materialise(ranked.select(*by, F.col("l_" + key).alias(key), F.col("r_" + key).alias("neighbour"), "distance", "rank"))
        out = ranked if out is None else out.unionByName(ranked)
        todo = materialise(todo.where("__all > 1").join(ranked.select(*by, key).distinct(), [*by, key], "left_anti"))
        if todo.isEmpty():
            return out
        radius *= 2
    raise RuntimeError("neighbours were not found; is a coordinate missing?")


def best_match(pairs: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """For each key the value that comes first in ``order``."""
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(value).alias("v"))
    return pairs.groupBy(key).agg(F.min(rank)["v"].alias(name))


def distance(ax: str, ay: str, bx: str, by_: str) -> Column:
    return hypot(F.col(ax) - F.col(bx), F.col(ay) - F.col(by_))
