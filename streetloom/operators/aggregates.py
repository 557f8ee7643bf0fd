"""Aggregates: columns to use in ``agg``, and frames where an aggregate needs a step before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetloom.config import CONFIG


def weighted_mean(x: Column, weight: Column) -> Column:
    """Over rows in which both are known; none: null."""
    known = x.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(known, x * weight)), F.sum(F.when(known, weight)))


def weighted_share(flag: Column, weight: Column) -> Column:
    """Weight of the true rows among those that are true or false."""
    return F.try_divide(F.sum(F.when(flag, weight).when(~flag, F.lit(0.0))), F.sum(F.when(flag.isNotNull(), weight)))


def cardinal_share(bearing: Column) -> Column:
    """Share of rows within 5 degrees (and 1e-5 of the target) of 0, 90, 180, 270 or 360."""
    near = F.lit(False)
    for target in (0, 90, 180, 270, 360):
        near = near | (F.abs(bearing - target) <= 5 + 1e-5 * target)
    return F.avg(F.coalesce(near, F.lit(False)).cast("double"))


def weighted_median(df: DataFrame, keys: list[str], x: str, weight: str, name: str) -> DataFrame:
    """Least ``x`` at which the weight so far reaches half; rows with a null are left out.

    Equal values are summed first, so a group reaches its window already reduced.
    """
    known = df.where(F.col(x).isNotNull() & F.col(weight).isNotNull())
    values = known.groupBy(*keys, F.col(x).alias("__x")).agg(F.sum(weight).alias("__w"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumns({"__cum": F.sum("__w").over(upto), "__all": F.sum("__w").over(group)})
    return ranked.where(F.col("__cum") >= F.col("__all") / 2).groupBy(*keys).agg(F.min("__x").alias(name))


def angle_bin(bearing: Column, bins: int = CONFIG.entropy_bins, shift: float = CONFIG.entropy_shift) -> Column:
    """Bin of a shifted bearing over [-180, 180]; the last bin is closed, what lies beyond has none."""
    moved = bearing + shift
    at = F.least(F.floor((moved + 180) / (360.0 / bins)).cast("int"), F.lit(bins - 1))
    return F.when((moved >= -180) & (moved <= 180), at)


def angle_entropy(df: DataFrame, keys: list[str], bearing: str, weight: str, name: str) -> DataFrame:
    """Shannon entropy (bits) of weight over bearing bins."""
    bins = df.select(*keys, angle_bin(F.col(bearing)).alias("__bin"), F.col(weight).alias("__w")).where("__bin is not null")
    bins = bins.groupBy(*keys, "__bin").agg(F.sum("__w").alias("__w"))
    total = F.sum("__w").over(Window.partitionBy(*keys))
    shares = bins.withColumn("__p", F.try_divide(F.col("__w"), total)).where("__p > 0")
    return shares.groupBy(*keys).agg((-F.sum(F.col("__p") * F.log2("__p"))).alias(name))


def mean_std(columns: list[str], suffix: str, std_only: tuple[str, ...] = ()) -> list[Column]:
    """``{column}{suffix}mean`` and ``...std`` (sample) for each column."""
    out = []
    for c in columns:
        if c not in std_only:
            out.append(F.avg(f"`{c}`").alias(f"{c}{suffix}mean"))
        out.append(F.stddev_samp(f"`{c}`").alias(f"{c}{suffix}std"))
    return out


def smallest_mode(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent non-null value, of several the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by("__v", F.struct(-F.col("__n"), F.col("__v"))).alias(name))


def heaviest(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Value with the greatest sum of weights, of several the smallest."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.sum(weight).alias("__w"))
    return sums.groupBy(*keys).agg(F.min_by("__v", F.struct(-F.col("__w"), F.col("__v"))).alias(name))


def group_spread(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Sample deviation of each column in the row's group, beside every row as ``{column}_std``.

    Aggregated and joined back rather than windowed, so that a large group is
    never brought to one task.
    """
    spread = df.groupBy(group).agg(*(F.stddev_samp(c).alias(f"{c}_std") for c in columns))
    return df.join(spread, group)


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: type, non-null share, and least, greatest and mean value where these make sense. One pass."""
    numeric = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    parts = [F.count("*").alias("__rows")]
    for i, (c, _) in enumerate(df.dtypes):
        col = F.col(f"`{c}`")
        parts.append(F.count(col).alias(f"n{i}"))
        if c in numeric:
            parts += [F.min(col).cast("double").alias(f"lo{i}"), F.max(col).cast("double").alias(f"hi{i}"), F.avg(col).alias(f"mean{i}")]
    one = df.agg(*parts)
    rows = F.array(*(
        F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("__rows").alias("rows"), F.try_divide(F.col(f"n{i}"), F.col("__rows")).alias("known"),
            *((F.col(f"{p}{i}") if c in numeric else F.lit(None).cast("double")).alias(n) for p, n in (("lo", "least"), ("hi", "greatest"), ("mean", "mean"))),
        ) for i, (c, t) in enumerate(df.dtypes)
    ))
    return one.select(F.inline(rows))


def top_values(df: DataFrame, column: str, n: int = 7) -> DataFrame:
    """The most frequent non-null values with their counts."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(n)


def probability_histogram(df: DataFrame, keys: list[str], x: str, bins: int = CONFIG.histogram_bins) -> DataFrame:
    """Equal-width bins from least to greatest value of each group.

    ``keys, bin, low, high, probability, median``. Every bin excludes its upper
    bound, so the greatest value is in none; an empty bin has median 0.
    """
    known = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"))
    span = known.groupBy(*keys).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    inside = (known.join(span, keys) if keys else known.join(F.broadcast(span))).where("__x < __hi")
    found = inside.withColumn("bin", F.least(F.floor((F.col("__x") - F.col("__lo")) / width), F.lit(bins - 1)).cast("int"))
    found = found.groupBy(*keys, "bin").agg(F.count("*").alias("__n"), F.percentile("__x", F.lit(0.5)).alias("__mid"))
    frame = span.select(*keys, "__lo", width.alias("__width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = frame.join(found, [*keys, "bin"], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    total = filled.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    filled = filled.join(total, keys) if keys else filled.join(F.broadcast(total))
    low = F.col("__lo") + F.col("bin") * F.col("__width")
    return filled.select(*keys, "bin", low.alias("low"), (low + F.col("__width")).alias("high"), F.try_divide("__n", "__total").alias("probability"), F.coalesce("__mid", F.lit(0.0)).alias("median"))


def group_z_scores(df: DataFrame, group: str, columns: list[str], top: int = 3) -> DataFrame:
    """The ``top`` columns in which each group's mean is furthest from the overall mean, in overall deviations."""
    overall = df.agg(*(x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"__m{i}"), F.stddev_samp(c).alias(f"__s{i}"))))
    means = df.groupBy(group).agg(*(F.avg(c).alias(c) for c in columns)).join(F.broadcast(overall))
    scores = F.array(*(F.struct(F.lit(c).alias("feature"), F.try_divide(F.col(c) - F.col(f"__m{i}"), F.col(f"__s{i}")).alias("z")) for i, c in enumerate(columns)))
    long = means.select(group, F.inline(scores)).where("z is not null")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.abs("z")), "feature"))
    return long.withColumn("rank", rank).where(F.col("rank") <= top)


def sample_groups(df: DataFrame, group: str, key: str, n: int = CONFIG.sample_rows, salts: int = 32) -> DataFrame:
    """At most ``n`` rows of each group, chosen by the hash of ``key``.

    Two steps: the first ``n`` of each part of a group, then of the group, so
    that a large group is ranked in parts.
    """
    order = F.xxhash64(F.col(key)), F.col(key)
    part = Window.partitionBy(group, F.pmod(F.hash(key), F.lit(salts))).orderBy(*order)
    some = df.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= n)
    return some.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
