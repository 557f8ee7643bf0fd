"""Regular grids and rasters as tables.

A grid is a frame of ``i, j`` (column, row) with ``minx, miny``; a raster is
``row, col, value`` with six affine numbers ``a, b, c, d, e, f``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.config import BUILDING_CLASS_CODES, CONFIG
from streetloom.functions.geometry import hypot
from streetloom.graph.components import connected_components
from streetloom.operators.aggregates import heaviest, smallest_mode

Affine = tuple[float, float, float, float, float, float]


def create_grid(spark: SparkSession, minx: float, miny: float, maxx: float, maxy: float, size: float = CONFIG.cell) -> DataFrame:
    """Whole cells of the extent, ``cell`` numbered column by column."""
    columns, rows = int((maxx - minx) / size), int((maxy - miny) / size)
    cell = spark.range(columns * rows).withColumnRenamed("id", "cell")
    i, j = F.expr(f"cell div {max(rows, 1)}"), F.col("cell") % max(rows, 1)
    return cell.select("cell", i.cast("int").alias("i"), j.cast("int").alias("j"), (minx + i * size).alias("minx"), (miny + j * size).alias("miny"))


def distance_to(grid: DataFrame, x: Column, y: Column, size: float = CONFIG.cell, name: str = "distance_to_city_center") -> DataFrame:
    return grid.withColumn(name, hypot(F.col("minx") + size / 2 - x, F.col("miny") + size / 2 - y))


def cells_of(features: DataFrame, minx: float, miny: float, size: float = CONFIG.cell) -> DataFrame:
    """A row for each cell that a feature's box meets, with ``i, j`` and the area of their overlap as ``overlap``.

    The cell is the join key itself, so features meet a grid by an equi-join.
    """
    lo = lambda c, m: F.floor((F.col(f"min{c}") - m) / size).cast("int")
    hi = lambda c, m: F.greatest(F.floor((F.col(f"min{c}") - m) / size), F.ceil((F.col(f"max{c}") - m) / size) - 1).cast("int")
    out = features.withColumn("i", F.explode(F.sequence(lo("x", minx), hi("x", minx)))).withColumn("j", F.explode(F.sequence(lo("y", miny), hi("y", miny))))
    left, low = minx + F.col("i") * size, miny + F.col("j") * size
    wide = F.least(F.col("maxx"), left + size) - F.greatest(F.col("minx"), left)
    high = F.least(F.col("maxy"), low + size) - F.greatest(F.col("miny"), low)
    return out.withColumn("overlap", F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high))


def grid_aggregates(grid: DataFrame, placed: DataFrame, layer: str, mode: list[str] = (), most: list[str] = (), mean: list[str] = (), total: list[str] = (), count: list[str] = ()) -> DataFrame:
    """The grid with ``{layer}::{column}::{mode|most_intersecting|mean|sum|count}``.

    Modes and heaviest categories take the smallest of equals, sums and counts
    are 0 in empty cells. Line layers have no overlap area, so their heaviest
    category is the smallest one.
    """
    key = ["i", "j"]
    out = grid
    plain = [
        *(F.avg(c).alias(f"{layer}::{c}::mean") for c in mean), *(F.sum(c).alias(f"{layer}::{c}::sum") for c in total),
        *(F.count(c).alias(f"{layer}::{c}::count") for c in count),
    ]
    if plain:
        out = out.join(placed.groupBy(*key).agg(*plain), key, "left")
        out = out.fillna(0, [f"{layer}::{c}::{k}" for k, cs in (("sum", total), ("count", count)) for c in cs])
    for c in mode:
        out = out.join(smallest_mode(placed, key, c, f"{layer}::{c}::mode"), key, "left")
    for c in most:
        out = out.join(heaviest(placed, key, c, "overlap", f"{layer}::{c}::most_intersecting"), key, "left")
    return out


def modal_filter(grid: DataFrame, column: str, name: str, missing=CONFIG.missing_cell) -> DataFrame:
    """Most frequent value of the 3x3 cells around each cell, of several the smallest.

    Outside the grid the border cells are repeated. Missing values count as
    ``missing``. Each cell goes to the nine cells that see it; as a border cell
    is seen more than once by its own neighbours, offsets are clamped.
    """
    edge = grid.agg(F.max("i").alias("__mi"), F.max("j").alias("__mj"))
    kind = dict(grid.dtypes)[column]
    value = F.coalesce(F.col(f"`{column}`"), F.lit(missing).cast(kind)).alias("v")
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    seen = grid.select("i", "j").join(F.broadcast(edge)).withColumn("s", F.explode(steps)).select(
        "i", "j", F.greatest(F.lit(0), F.least(F.col("__mi"), F.col("i") + F.col("s.a"))).alias("ni"), F.greatest(F.lit(0), F.least(F.col("__mj"), F.col("j") + F.col("s.b"))).alias("nj"),
    )
    values = grid.select(F.col("i").alias("ni"), F.col("j").alias("nj"), value)
    found = smallest_mode(seen.join(values, ["ni", "nj"]), ["i", "j"], "v", name)
    return grid.join(found, ["i", "j"], "left")


def to_numpy(grid: DataFrame, column: str, columns: int, rows: int, missing: int = CONFIG.missing_cell):
    """The grid as an array ``[column, row]`` on the driver (a city's grid is small: a cell is a hectare)."""
    import numpy as np

    out = np.full((columns, rows), missing)
    for r in grid.select("i", "j", F.col(f"`{column}`").alias("v")).where("v is not null").toLocalIterator():
        out[r.i, r.j] = r.v
    return out


def class_code(label: Column) -> Column:
    out = F.lit(CONFIG.missing_cell)
    for name, code in BUILDING_CLASS_CODES.items():
        out = F.when(label == name, code).otherwise(out)
    return out


def cluster_code(value: Column) -> Column:
    """The whole part of a number or of text that holds one; 99 for anything else."""
    return F.coalesce(value.cast("string").try_cast("double").cast("int"), F.lit(CONFIG.missing_cell))


def sample_raster(points: DataFrame, raster: DataFrame, affine: Affine, name: str = "value") -> DataFrame:
    """The cell value under each point ``x, y``, null outside: the inverse affine map gives row and column, joined by equality."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    dx, dy = F.col("x") - c, F.col("y") - f
    whole = lambda v: v.cast("int")  # noqa: E731  toward zero
    at = points.withColumn("__col", whole((e * dx - b * dy) / det)).withColumn("__row", whole((a * dy - d * dx) / det))
    cells = raster.select(F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("value").alias(name))
    return at.join(cells, ["__row", "__col"], "left").drop("__row", "__col")


def raster_points(raster: DataFrame, affine: Affine) -> DataFrame:
    """A point for each cell, at its corner."""
    a, b, c, d, e, f = affine
    return raster.select((a * F.col("col") + b * F.col("row") + c).alias("x"), (d * F.col("col") + e * F.col("row") + f).alias("y"), "value")


def resample_nearest(target: DataFrame, raster: DataFrame, target_affine: Affine, source_affine: Affine) -> DataFrame:
    """Values of ``raster`` at the cell centres of ``target`` (``row, col``)."""
    a, b, c, d, e, f = target_affine
    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    points = target.select("row", "col", (a * x + b * y + c).alias("x"), (d * x + e * y + f).alias("y"))
    return sample_raster(points, raster, source_affine).select("row", "col", "value")


def mosaic(tiles: list[DataFrame]) -> DataFrame:
    """Tiles on one grid as a raster; where they overlap, the first tile with a value."""
    parts = [t.select("row", "col", "value", F.lit(i).alias("tile")) for i, t in enumerate(tiles)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.where("value is not null").groupBy("row", "col").agg(F.min_by("value", "tile").alias("value"))


def crop(raster: DataFrame, affine: Affine, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Cells whose corner lies in the box."""
    a, b, c, d, e, f = affine
    x, y = a * F.col("col") + b * F.col("row") + c, d * F.col("col") + e * F.col("row") + f
    return raster.where((x >= minx) & (x <= maxx) & (y >= miny) & (y <= maxy))


def patches(grid: DataFrame, column: str, size: float = CONFIG.cell) -> DataFrame:
    """Patches of equal neighbouring cells (by sides): ``patch, value, cells, area, perimeter``; ``patch`` is its least cell."""
    known = grid.where(F.col(f"`{column}`").isNotNull()).select("cell", "i", "j", F.col(f"`{column}`").alias("value"))
    other = known.select(F.col("cell").alias("b"), F.col("i").alias("bi"), F.col("j").alias("bj"), "value")
    step = known.withColumn("s", F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))))
    step = step.select("cell", "value", (F.col("i") + F.col("s.a")).alias("bi"), (F.col("j") + F.col("s.b")).alias("bj"))
    links = step.join(other, ["bi", "bj", "value"]).select("cell", "b")
    label = connected_components(links, "cell", "b").withColumnsRenamed({"node": "cell"})
    inner = links.groupBy("cell").agg(F.count("*").alias("n"))
    rows = known.join(label, "cell", "left").join(inner, "cell", "left").withColumn("patch", F.coalesce("component", "cell"))
    return rows.groupBy("patch").agg(
        F.first("value").alias("value"), F.count("*").alias("cells"), (F.count("*") * F.lit(size * size)).alias("area"),
        ((4 * F.count("*") - 2 * F.sum(F.coalesce("n", F.lit(0)))) * F.lit(size)).alias("perimeter"),
    )


def scaled_band(grid: DataFrame, column: str) -> DataFrame:
    """``i, j, band``: a column as bytes, numbers by least and greatest value, booleans 255 or 0, missing 99."""
    kind = dict(grid.dtypes)[column]
    c = F.col(f"`{column}`")
    if kind == "boolean":
        return grid.select("i", "j", F.when(c, 255).when(~c, 0).otherwise(99).alias("band"))
    span = F.broadcast(grid.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi")))
    value = F.try_divide(c - F.col("__lo"), F.col("__hi") - F.col("__lo")) * 255
    return grid.join(span).select("i", "j", F.coalesce(value.cast("int"), F.lit(99)).alias("band"))


# Colours that land uses always have.
FIXED_COLOURS = {"industrial": (255, 0, 0), "residential": (0, 255, 0), "commercial": (0, 0, 255), "office": (255, 255, 0), "retail": (255, 0, 255)}


def palette(values: list[str]) -> dict[str, tuple[int, int, int]]:
    """A colour for each category: the fixed one, or evenly spaced hues for the others in order."""
    import colorsys

    free = [v for v in sorted(values) if v not in FIXED_COLOURS]
    hues = {v: tuple(int(c * 255) for c in colorsys.hsv_to_rgb(i / len(free), 0.75, 0.95)) for i, v in enumerate(free)}
    return {v: FIXED_COLOURS.get(v) or hues[v] for v in values}


def coloured_bands(grid: DataFrame, column: str) -> DataFrame:
    """``i, j, red, green, blue`` of a categorical column; missing cells are black. (Categories are few: one row each comes to the driver.)"""
    c = F.col(f"`{column}`")
    colours = palette([r[0] for r in grid.where(c.isNotNull()).select(c).distinct().collect()])
    bands = []
    for k, name in enumerate(("red", "green", "blue")):
        out = F.lit(0)
        for value, rgb in colours.items():
            out = F.when(c == value, rgb[k]).otherwise(out)
        bands.append(out.alias(name))
    return grid.select("i", "j", *bands)
