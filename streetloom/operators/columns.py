"""Projections, filters, scaling and row numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.config import OSM_RENAMES
from streetloom.functions.scalars import building_subtype, no_nan
from streetloom.plans.shared import materialise


def keep_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*(F.col(f"`{c}`") for c in wanted if c in df.columns))


def rename_existing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating column with null in the place of NaN."""
    return df.select(*(no_nan(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def osm_buildings(df: DataFrame) -> DataFrame:
    """Six tags of polygons under their new names, with the subtype of the building tag."""
    polygons = df.where(F.col("geom_type") == "Polygon") if "geom_type" in df.columns else df
    named = rename_existing(keep_existing(polygons, ["id", "geom", *OSM_RENAMES]), OSM_RENAMES)
    return named.withColumn("subtype", building_subtype(F.col("class"))) if "class" in named.columns else named


def overture_buildings(df: DataFrame) -> DataFrame:
    """Source and confidence of the first source, primary name, and height or else roof height."""
    first = F.get("sources", F.lit(0))
    return df.withColumns({
        "source": first["dataset"], "confidence": first["confidence"], "name": F.col("names")["primary"],
        "real_height": F.coalesce("height", "roof_height").cast("string"), "real_levels": F.col("num_floors").cast("string"),
    })


def in_extent(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, box: str = "bbox") -> DataFrame:
    """Rows whose box overlaps the extent strictly. The bounds are pushed down to a Parquet scan."""
    b = F.col(box)
    return df.where((b["xmin"] < xmax) & (b["xmax"] > xmin) & (b["ymin"] < ymax) & (b["ymax"] > ymin))


def parse_filter(text: str) -> Column:
    """``column=value`` as a condition; the value is compared as text."""
    parts = text.split("=")
    if len(parts) != 2:
        raise ValueError(f"expected column=value, got {text!r}")
    return F.col(f"`{parts[0].strip()}`").cast("string") == parts[1].strip()


def training_rows(df: DataFrame, label: str, excluded: list[str]) -> DataFrame:
    return df.where(F.col(label).isNotNull() & ~F.col(label).isin(excluded))


def fill_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna("UNKNOWN", [c for c in columns if c in df.columns])


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which no column is null or NaN."""
    return df.dropna(subset=columns)


def require_nonzero(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or an error if a column holds nothing but zeros and nulls. One pass over the columns."""
    top = df.agg(*(F.max(F.abs(F.col(f"`{c}`"))).alias(c) for c in columns)).first()
    if zero := [c for c in columns if not top[c]]:
        raise ValueError(f"only zeros in {zero}")
    return df


def _with_statistics(df: DataFrame, columns: list[str], statistics) -> tuple[DataFrame, object]:
    """``df`` beside one row of statistics of its columns (broadcast: one row whatever the input)."""
    row = df.agg(*(s.alias(f"__{n}_{i}") for i, c in enumerate(columns) for n, s in statistics(F.col(f"`{c}`")).items()))
    return df.join(F.broadcast(row)), lambda i, n: F.col(f"__{n}_{i}")


def _rescale(df: DataFrame, columns: list[str], statistics, scale) -> DataFrame:
    beside, at = _with_statistics(df, columns, statistics)
    new = {c: scale(F.col(f"`{c}`"), lambda n, i=i: at(i, n)) for i, c in enumerate(columns)}
    return beside.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to [0, 1]; null where all values are equal."""
    return _rescale(df, columns, lambda c: {"lo": F.min(c), "hi": F.max(c)}, lambda c, s: F.try_divide(c - s("lo"), s("hi") - s("lo")))


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean, by its sample deviation."""
    return _rescale(df, columns, lambda c: {"mean": F.avg(c), "sd": F.stddev_samp(c)}, lambda c, s: F.try_divide(c - s("mean"), s("sd")))


def normalise_and_clip(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scaled by minimum and 99th percentile, at most 1; columns named ...id stay, constant ones are only clipped."""
    chosen = [c for c in columns if not c.endswith("id")]

    def scale(c: Column, s) -> Column:
        value = F.when(s("hi") > s("lo"), (c - s("lo")) / (s("hi") - s("lo"))).otherwise(c)
        return F.when(c.isNotNull(), F.least(value, F.lit(1.0)))

    return _rescale(df, chosen, lambda c: {"lo": F.percentile(c, F.lit(0.0)), "hi": F.percentile(c, F.lit(0.99))}, scale)


def with_row_id(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``keys``, without bringing them to one task.

    Rows are range-partitioned and numbered inside their partition; the
    partitions' sizes (a row each) give the offsets.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("__p", F.shiftrightunsigned("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("__p").count().collect())
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    offsets = df.sparkSession.createDataFrame(starts, "__p long, __start long")
    return placed.join(F.broadcast(offsets), "__p").select(*df.columns, (F.col("__start") + F.col("__i")).alias(name))


def every_nth(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows 0, n, 2n, ... in the order of ``keys``."""
    return with_row_id(df, keys, "__row").where(F.col("__row") % n == 0).drop("__row")


def update_from(df: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which a value of ``new`` replaces that of ``df`` unless it is null."""
    shared = [c for c in new.columns if c not in on]
    renamed = new.select(*on, *(F.col(f"`{c}`").alias(f"__new_{c}") for c in shared))
    joined = df.join(renamed, on, "left")
    kept = [F.coalesce(F.col(f"`__new_{c}`"), F.col(f"`{c}`")).alias(c) if c in shared else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*kept, *(F.col(f"`__new_{c}`").alias(c) for c in shared if c not in df.columns))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def complete_names(df: DataFrame, prefix: str, chosen: list[str] = ()) -> list[str]:
    """Numeric columns that begin with ``prefix`` in any case and are not chosen yet."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and c not in chosen and c.lower().startswith(prefix.lower())]
