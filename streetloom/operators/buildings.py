"""Metrics of buildings, their groups and their enclosures.

Buildings: ``id, geom`` (polygon), ``minx, miny, maxx, maxy``. Kernels see one
polygon, or one group of touching buildings, at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.config import CONFIG
from streetloom.functions import geometry as g
from streetloom.functions import kernels
from streetloom.functions.scalars import clip
from streetloom.graph.components import connected_components
from streetloom.operators.spatial import box_join, nearest_neighbours, radius_join
from streetloom.plans.shared import materialise


def measured(df: DataFrame) -> DataFrame:
    """With ``area, perimeter, x, y`` (centroid)."""
    c = g.centroid(F.col("geom"))
    return df.withColumns({"area": g.area(F.col("geom")), "perimeter": g.perimeter(F.col("geom")), "x": c["x"], "y": c["y"]})


def framed(df: DataFrame) -> DataFrame:
    """With shape indices from the least rectangle and circle around a polygon. ``df`` needs ``area, perimeter``."""
    ring = F.get("geom", F.lit(0))
    corner = [F.get(ring, F.lit(i)) for i in range(3)]
    # A rectangle is its own frame; only other shapes go to Python, in their place a null.
    sides = [F.struct(g.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("size"), F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])).alias("turn")) for a, b in zip(corner, corner[1:], strict=False)]
    long_side, short_side = F.greatest(*sides), F.least(*sides)
    own = F.struct(long_side["size"].alias("long_side"), short_side["size"].alias("short_side"), long_side["turn"].alias("direction"), (g.hypot(long_side["size"], short_side["size"]) / 2).alias("radius"))
    marked = df.withColumn("__own", F.when(g.is_rectangle(F.col("geom")), own))
    f = marked.withColumn("__f", F.coalesce("__own", kernels.frame_of(F.when(F.col("__own").isNull(), ring)))).drop("__own")
    long_, short, turn, radius = (F.col(f"__f.{c}") for c in ("long_side", "short_side", "direction", "radius"))
    box = long_ * short
    deviation = F.pmod(turn, F.lit(90.0))
    return f.withColumns({
        "equivalent_rectangular_index": F.sqrt(F.try_divide(F.col("area"), box)) * F.try_divide(2 * (long_ + short), F.col("perimeter")),
        "elongation": F.try_divide(short, long_), "rectangularity": F.try_divide(F.col("area"), box),
        "shape_index": F.try_divide(F.sqrt(F.col("area") / F.pi()), radius), "circular_compactness": F.try_divide(F.col("area"), F.pi() * radius * radius),
        "orientation": F.when(deviation > 45, 90 - deviation).otherwise(deviation),
    }).drop("__f")


def simple_ratios(df: DataFrame) -> DataFrame:
    """``fractal_dimension, perimeter_area_ratio, squareness`` from area and perimeter."""
    return df.withColumns({
        "fractal_dimension": F.try_divide(2 * F.log(F.col("perimeter") / 4), F.log("area")),
        "perimeter_area_ratio": F.try_divide("perimeter", "area"), "squareness": g.squareness(F.col("geom")),
    })


def form_factor(area: Column, perimeter: Column, height: Column) -> Column:
    """Surface by volume to the power of two thirds."""
    return F.try_divide(perimeter * height + area, F.pow(area * height, F.lit(2 / 3)))


def _sides_of(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def walls(df: DataFrame) -> DataFrame:
    """A row for each side of the outer ring: ``id, x1, y1, x2, y2`` and its box."""
    out = df.select("id", F.inline(_sides_of(F.get("geom", F.lit(0)))))
    return out.withColumns({"minx": F.least("x1", "x2"), "miny": F.least("y1", "y2"), "maxx": F.greatest("x1", "x2"), "maxy": F.greatest("y1", "y2")})


def shared_walls(df: DataFrame, cell: float = 50.0) -> DataFrame:
    """``id, shared_walls_ratio``: length of walls that lie on walls of others, by the perimeter."""
    side = walls(df)
    a = [F.col(f"l_{c}") for c in ("x1", "y1", "x2", "y2")]
    b = [F.col(f"r_{c}") for c in ("x1", "y1", "x2", "y2")]
    straight = (g.side_of(*a, b[0], b[1]) == 0) & (g.side_of(*a, b[2], b[3]) == 0)
    dx, dy = a[2] - a[0], a[3] - a[1]
    size = g.hypot(dx, dy)
    at = lambda x, y: F.try_divide((x - a[0]) * dx + (y - a[1]) * dy, size)
    s, e = F.least(at(b[0], b[1]), at(b[2], b[3])), F.greatest(at(b[0], b[1]), at(b[2], b[3]))
    overlap = F.greatest(F.lit(0.0), F.least(e, size) - F.greatest(s, F.lit(0.0)))
    pairs = box_join(side, side, cell, straight & (F.col("l_id") != F.col("r_id")))
    shared = pairs.groupBy(F.col("l_id").alias("id")).agg(F.sum(overlap).alias("shared"))
    return df.select("id", "perimeter").join(shared, "id", "left").select("id", F.coalesce(F.try_divide("shared", "perimeter"), F.lit(0.0)).alias("shared_walls_ratio"))


def touching(df: DataFrame, cell: float = 50.0) -> DataFrame:
    """Pairs ``a < b`` of buildings with a common point of their walls (of polygons that do not overlap: that touch).

    Boxes are joined first; walls are compared only where boxes meet.
    """
    slim = df.select("id", "minx", "miny", "maxx", "maxy", _sides_of(F.get("geom", F.lit(0))).alias("sides"))
    pairs = box_join(slim, slim, cell, F.col("l_id") < F.col("r_id"))
    one = pairs.select("l_id", "r_id", "r_sides", F.inline("l_sides").alias("a1", "b1", "a2", "b2"))
    both = one.select("l_id", "r_id", "a1", "b1", "a2", "b2", F.inline("r_sides"))
    meet = g.segment_gap([F.col(c) for c in ("a1", "b1", "a2", "b2")], [F.col(c) for c in ("x1", "y1", "x2", "y2")]) == 0
    return both.where(meet).select(F.col("l_id").alias("a"), F.col("r_id").alias("b")).distinct()


def building_groups(df: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``id, building_group_id``: components of touching buildings (``pairs``, if known), named by the least id."""
    found = connected_components(touching(df) if pairs is None else pairs, "a", "b").withColumnsRenamed({"node": "id", "component": "g"})
    return df.select("id").join(found, "id", "left").select("id", F.coalesce("g", "id").alias("building_group_id"))


def group_courtyards(df: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``building_group_id, building_group_area, building_group_courtyard_index``: courtyard area by the group's own, within [0, 1].

    A building's own holes are courtyards. Rectangles that touch in a tree
    (one pair of touching ones less than there are) close in nothing between
    them, so the union is built only of groups with a circle, or with other
    shapes. ``pairs``: touching buildings, if known.
    """
    pairs = touching(df) if pairs is None else pairs
    own = df.select("id", "building_group_id", F.get("geom", F.lit(0)).alias("ring"), g.area(F.col("geom")).alias("net"), g.is_rectangle(F.col("geom")).alias("box"))
    links = pairs.join(own.select(F.col("id").alias("a"), "building_group_id"), "a").groupBy("building_group_id").agg(F.count("*").alias("links"))
    sums = own.groupBy("building_group_id").agg(F.count("*").alias("n"), F.sum("net").alias("net"), F.sum(g.ring_area(F.col("ring"))).alias("outer"), F.min("box").alias("boxes"))
    sums = materialise(sums.join(links, "building_group_id", "left").fillna(0, ["links"]))
    plain = (F.col("n") == 1) | (F.col("boxes") & (F.col("links") == F.col("n") - 1))
    rings = own.join(sums.where(~plain).select("building_group_id"), "building_group_id", "left_semi").groupBy("building_group_id").agg(F.collect_list("ring").alias("rings"))
    built = sums.where(~plain).join(rings, "building_group_id").withColumn("outer", kernels.filled_area("rings")).drop("rings")
    found = sums.where(plain).unionByName(built)
    yard = clip(F.try_divide(F.col("outer") - F.col("net"), F.col("net")), 0.0, 1.0)
    return found.select("building_group_id", F.col("net").alias("building_group_area"), yard.alias("building_group_courtyard_index"))


def largest_enclosure(df: DataFrame, enclosures: DataFrame, cell: float = 200.0) -> DataFrame:
    """``id, enclosure_id``: of the enclosures whose box meets the building's, the one of greatest area (then least id)."""
    pairs = box_join(df.select("id", "minx", "miny", "maxx", "maxy"), enclosures.select("enclosure_id", "area", "minx", "miny", "maxx", "maxy"), cell)
    best = pairs.groupBy(F.col("l_id").alias("id")).agg(F.min(F.struct(-F.col("r_area"), F.col("r_enclosure_id").alias("e")))["e"].alias("enclosure_id"))
    return df.select("id").join(best, "id", "left")


def landuse_of(df: DataFrame, landuse: DataFrame, cell: float = 500.0) -> DataFrame:
    """``id, land_use_category``: class of the landuse of least id whose box meets the building's."""
    pairs = box_join(df.select("id", "minx", "miny", "maxx", "maxy"), landuse.select("landuse_id", "landuse_class", "minx", "miny", "maxx", "maxy"), cell)
    best = pairs.groupBy(F.col("l_id").alias("id")).agg(F.min_by("r_landuse_class", "r_landuse_id").alias("land_use_category"))
    return df.select("id").join(best, "id", "left")


def enclosure_building_ratio(enclosures: DataFrame, df: DataFrame) -> DataFrame:
    """``enclosure_id, enclosure_building_area_ratio``: building area by enclosure area; 0 without buildings."""
    built = df.groupBy("enclosure_id").agg(F.sum("area").alias("built"))
    return enclosures.join(built, "enclosure_id", "left").select("enclosure_id", F.try_divide(F.coalesce("built", F.lit(0.0)), F.col("area")).alias("enclosure_building_area_ratio"))


def perimeter_coverage(groups: DataFrame, enclosures: DataFrame, inset: float = CONFIG.enclosure_inset, cell: float = 200.0) -> DataFrame:
    """``building_group_id, building_group_enclosure_perimeter_coverage``.

    How much of the border of the (convex) enclosure, moved inwards, lies in
    the group; of several enclosures that meet the group the one of least id.
    ``groups``: ``building_group_id, geom`` for each building of it.
    """
    boxes = groups.select("building_group_id", "minx", "miny", "maxx", "maxy")
    met = box_join(boxes, enclosures.select("enclosure_id", "minx", "miny", "maxx", "maxy"), cell)
    first = met.groupBy(F.col("l_building_group_id").alias("building_group_id")).agg(F.min("r_enclosure_id").alias("enclosure_id"))
    return coverage_of(groups.select("building_group_id", "geom").join(first, "building_group_id").join(enclosures.select("enclosure_id", F.col("geom").alias("around")), "enclosure_id"), inset)


def coverage_of(rows: DataFrame, inset: float = CONFIG.enclosure_inset) -> DataFrame:
    """The same for rows that already carry their enclosure as ``around``."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        line = kernels.inset_convex(kernels.ring_of(pdf["around"].iloc[0]), inset)
        whole = sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(line, line[1:] + line[:1], strict=True))
        share = kernels.covered_length(line, [kernels.ring_of(p) for p in pdf["geom"]]) / whole if whole else None
        return pd.DataFrame([(key[0], share)], columns=["building_group_id", "share"])

    found = rows.select("building_group_id", "geom", "around").groupBy("building_group_id").applyInPandas(one, "building_group_id long, share double")
    return found.withColumnRenamed("share", "building_group_enclosure_perimeter_coverage")


def neighbour_metrics(df: DataFrame, k: int = CONFIG.knn, start: float = 100.0) -> DataFrame:
    """``id, alignment, covered_area`` over the ``k`` nearest buildings: mean difference of orientation, summed area with its own."""
    near = nearest_neighbours(df.select("id", "x", "y"), k, "id", start)
    other = df.select(F.col("id").alias("neighbour"), F.col("orientation").alias("o"), F.col("area").alias("a"))
    pairs = near.join(other, "neighbour").join(df.select("id", "orientation"), "id")
    found = pairs.groupBy("id").agg(F.avg(F.abs(F.col("orientation") - F.col("o"))).alias("alignment"), F.sum("a").alias("near_area"))
    return df.select("id", "area").join(found, "id", "left").select("id", "alignment", (F.col("area") + F.coalesce("near_area", F.lit(0.0))).alias("covered_area"))


def radius_context(df: DataFrame, aggregates: list[Column], radius: float = CONFIG.building_radius, by: list[str] = ()) -> DataFrame:
    """Aggregates over the buildings within ``radius`` of each building's centroid, itself included.

    ``df``: ``id, x, y`` and what the aggregates use. They see the neighbours'
    columns under their own names.
    """
    pairs = radius_join(df.select(*by, "id", "x", "y"), df, radius, by)
    plain = pairs.select(*by, F.col("l_id").alias("__focal"), *(F.col(f"`r_{c}`").alias(c) for c in df.columns if c not in by))
    return plain.groupBy(*by, "__focal").agg(*aggregates).withColumnRenamed("__focal", "id")


def plot_seeds(df: DataFrame, edges: DataFrame, closest: DataFrame) -> DataFrame:
    """``id, edge_id, cx, cy, px, py``: the shortest line from a building's centroid to its closest road; areas up to 10 are left out."""
    big = df.where(F.col("area") > CONFIG.tessellation_min_area)
    met = big.select("id", "x", "y").join(closest.select("id", "edge_id"), "id").join(edges.select("edge_id", "x1", "y1", "x2", "y2"), "edge_id")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return met.select("id", "edge_id", F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("x1") + t * dx).alias("px"), (F.col("y1") + t * dy).alias("py"))


def polygonise(lines: DataFrame, by: str = "city") -> DataFrame:
    """Enclosures of each city: the bounded faces of its lines ``x1, y1, x2, y2`` (which meet only at ends).

    ``by, enclosure_no, geom, area``, numbered by their lowest corner. A city's
    faces depend on all its lines, so one city is one task.
    """

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rings = sorted(kernels.faces([((r.x1, r.y1), (r.x2, r.y2)) for r in pdf.itertuples()]), key=lambda r: (min(r), len(r)))
        return pd.DataFrame([(key[0], i, [[{"x": x, "y": y} for x, y in [*r, r[0]]]], kernels.signed_area(r)) for i, r in enumerate(rings)], columns=[by, "enclosure_no", "geom", "area"])

    return lines.select(by, "x1", "y1", "x2", "y2").groupBy(by).applyInPandas(one, f"{by} string, enclosure_no long, geom {g.POLYGON}, area double")


def tessellation_areas(df: DataFrame, enclosures: DataFrame, step: float = 2.0) -> DataFrame:
    """``enclosure_id, id, area``: area of an enclosure that lies nearest to each of its buildings.

    The enclosure's box is sampled every ``step`` metres, and each sample goes
    to the building whose box is nearest (of equal ones the least id); a
    building that wins none has area 0.
    Buildings of under 10 square metres take part in nothing.

    An enclosure is cut into tiles of 64 x 64 samples. A tile looks at the
    buildings within its own width, and only if a sample of it has none so
    near does the tile go on to look four times as far, so neither a large
    enclosure nor a crowded one is a single task.
    """
    wide = _TILE * step
    houses = df.where(F.col("area") >= CONFIG.tessellation_min_area).select("enclosure_id", "id", "minx", "miny", "maxx", "maxy")
    nx, ny = (F.greatest(F.floor((F.col(f"max{c}") - F.col(f"min{c}")) / step).cast("int"), F.lit(0)) for c in "xy")
    reach = g.hypot(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    inhabited = enclosures.join(houses.select("enclosure_id"), "enclosure_id", "left_semi")
    frames = materialise(inhabited.select("enclosure_id", F.col("minx").alias("x0"), F.col("miny").alias("y0"), nx.alias("nx"), ny.alias("ny"), reach.alias("reach")).where("nx > 0 and ny > 0"))
    along = lambda n: F.sequence(F.lit(0), F.expr(f"({n} - 1) div {_TILE}").cast("int"))
    tiles = frames.withColumn("ti", F.explode(along("nx"))).withColumn("tj", F.explode(along("ny")))
    placed = materialise(houses.join(frames, "enclosure_id"))
    radius, most, won = wide, frames.agg(F.max("reach")).first()[0], None
    while most is not None:
        low, high = (lambda c: F.floor((F.col(f"min{c}") - radius - F.col(f"{c}0")) / wide)), (lambda c: F.floor((F.col(f"max{c}") + radius - F.col(f"{c}0")) / wide))
        last = lambda c: F.expr(f"(n{c} - 1) div {_TILE}").cast("int")
        span = lambda c: F.sequence(*(F.least(F.greatest(v.cast("int"), F.lit(0)), last(c)) for v in (low(c), high(c))))
        near = placed.withColumn("ti", F.explode(span("x"))).withColumn("tj", F.explode(span("y")))
        near = near.groupBy("enclosure_id", "ti", "tj").agg(F.collect_list(F.struct("id", "minx", "miny", "maxx", "maxy")).alias("houses"))
        done = tiles.join(near, ["enclosure_id", "ti", "tj"]).mapInArrow(_tile_kernel(step, radius), "enclosure_id long, ti int, tj int, id long, n long")
        done = materialise(done)
        won = done if won is None else won.unionByName(done)
        if radius > most:
            break
        tiles = materialise(tiles.join(done, ["enclosure_id", "ti", "tj"], "left_anti"))
        if tiles.isEmpty():
            break
        radius *= 4
        placed = placed.join(tiles.select("enclosure_id"), "enclosure_id", "left_semi")
    out = houses.select("enclosure_id", "id")
    if won is None:
        return out.withColumn("area", F.lit(0.0))
    total = won.groupBy("enclosure_id", "id").agg((F.sum("n") * F.lit(step * step)).alias("area"))
    return out.join(total, ["enclosure_id", "id"], "left").select("enclosure_id", "id", F.coalesce("area", F.lit(0.0)).alias("area"))


_TILE = 64  # samples along a tile


def _tile_kernel(step: float, radius: float):
    """Rows of tiles with their houses in; the samples that each house wins out. Tiles with a sample beyond ``radius`` of all are left out."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("enclosure_id", "x0", "y0", "nx", "ny", "ti", "tj")}
            lists = batch.column("houses")
            ends, flat = lists.offsets.to_numpy(), lists.values
            at = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("id", "minx", "miny", "maxx", "maxy")}
            for r in range(batch.num_rows):
                here = slice(ends[r], ends[r + 1])
                i0, j0 = int(cols["ti"][r]) * _TILE, int(cols["tj"][r]) * _TILE
                xs = cols["x0"][r] + (np.arange(i0, min(i0 + _TILE, int(cols["nx"][r]))) + 0.5) * step
                ys = cols["y0"][r] + (np.arange(j0, min(j0 + _TILE, int(cols["ny"][r]))) + 0.5) * step
                found = kernels.nearest_boxes(xs, ys, at["id"][here], np.stack([at[n][here] for n in ("minx", "miny", "maxx", "maxy")], 1), radius)
                if found is None:
                    continue
                for k, v in zip(out, (np.full(len(found[0]), cols["enclosure_id"][r]), np.full(len(found[0]), cols["ti"][r]), np.full(len(found[0]), cols["tj"][r]), *found), strict=True):
                    k.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["enclosure_id", "ti", "tj", "id", "n"])

    return run
