"""Tag tables, text and number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetloom.config import BUILDING_SUBTYPES, CONFIG, EDGE_CLASSES, FALLBACK_SPEED, LANDUSE_CLASSES, OTHER_EDGE_CLASS, SPEEDS, TYPE_CATEGORIES


def _choose(value: Column, groups: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, members in groups.items():
        if members:
            out = F.when(value.isin(members), name).otherwise(out)
    return out


def type_category(highway: Column) -> Column:
    """highway, major, street or path; null for other tags."""
    return _choose(highway, TYPE_CATEGORIES)


def edge_class(highway: Column) -> Column:
    """4 highway, 3 major, 2 street, 1 anything else (links of major roads and null included)."""
    out = F.lit(OTHER_EDGE_CLASS)
    for name, value in EDGE_CLASSES.items():
        out = F.when(highway.isin(TYPE_CATEGORIES[name]), value).otherwise(out)
    return out


def is_major(category: Column) -> Column:
    return F.coalesce(category.isin("major", "highway"), F.lit(False))


def landuse_class(landuse: Column) -> Column:
    return _choose(landuse, LANDUSE_CLASSES)


def building_subtype(tag: Column) -> Column:
    return _choose(tag, BUILDING_SUBTYPES)


def speed_kph(highway: Column) -> Column:
    pairs = [x for tag, speed in SPEEDS.items() for x in (F.lit(tag), F.lit(float(speed)))]
    return F.coalesce(F.create_map(*pairs)[highway], F.lit(float(FALLBACK_SPEED)))


def travel_time(length: Column, speed: Column) -> Column:
    """Seconds for ``length`` metres."""
    return F.try_divide(length, speed / 3.6)


def number(text: Column) -> Column:
    """A number, or null for what is none."""
    return text.try_cast("double")


def approximate_height(real_height: Column | None, real_levels: Column | None, raster_height: Column) -> Column:
    """Tagged height, else levels of three metres, else the raster's; only the raster's if a tag column is missing."""
    if real_height is None or real_levels is None:
        return raster_height.cast("double")
    return F.coalesce(number(real_height), number(real_levels) * CONFIG.level_height, raster_height.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def no_nan(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def capitalised(text: Column) -> Column:
    """First letter upper, the rest lower; blanks at the ends removed."""
    t = F.trim(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))


def file_name(text: Column) -> Column:
    """Characters other than letters, digits, ``_`` and ``-`` become ``_``."""
    return F.regexp_replace(text, r"[^\w-]", "_")


def layer_name(text: Column) -> Column:
    """Characters that table names must not hold become blanks."""
    return F.regexp_replace(text, r"[^\w ]", " ")


def boolean(text: Column) -> Column:
    """"true"/"false" in any case, else null."""
    t = F.lower(text)
    return F.when(t == "true", True).when(t == "false", False)


def id_list(text: Column) -> Column:
    """``[1, 2]`` as an array of longs; null if it is no such list."""
    return F.from_json(text, "array<bigint>")


def bbox(text: Column) -> Column:
    """``"w,s,e,n"`` as a struct; null unless it is four numbers."""
    parts = F.split(text, ",")
    ok = text.rlike(r"^-?\d+(\.\d+)?(,-?\d+(\.\d+)?){3}$")
    return F.when(ok, F.struct(*(F.get(parts, i).cast("double").alias(n) for i, n in enumerate(("west", "south", "east", "north")))))


def in_bbox(x: Column, y: Column, box: Column) -> Column:
    """Strictly inside."""
    return (x > box["west"]) & (x < box["east"]) & (y > box["south"]) & (y < box["north"])


def normalised_angle(degrees: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def bearing(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def axis_deviation(a: Column, b: Column) -> Column:
    """Angle between two undirected axes, in [0, 90]."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    d = F.when(d > 180, 360 - d).otherwise(d)
    return F.when(d > 90, 180 - d).otherwise(d)
