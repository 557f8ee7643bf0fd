"""A city as a set of named layers; many cities are one dataset, partitioned by ``city``."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.functions.scalars import file_name
from streetloom.operators.aggregates import profile, sample_groups
from streetloom.operators.columns import parse_filter, union_all


@dataclass
class City:
    """Layers by name. Paths may be on any file system that Spark reads."""

    layers: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, path: str, names: list[str], city: str | None = None) -> City:
        """Layers ``names`` below ``path``; ``city`` prunes the scan to its partition."""
        frames = {n: spark.read.parquet(f"{path}/{n}") for n in names}
        return cls({n: f.where(F.col("city") == city) if city is not None and "city" in f.columns else f for n, f in frames.items()})

    def write(self, path: str, names: list[str] | None = None) -> None:
        """Overwrites the layers; those with a ``city`` column are partitioned by it, and only the partitions written are replaced."""
        for n in names or list(self.layers):
            writer = self.layers[n].write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            (writer.partitionBy("city") if "city" in self.layers[n].columns else writer).parquet(f"{path}/{n}")

    def names(self) -> list[str]:
        return sorted(self.layers)

    def count(self, layer: str, condition: str | None = None) -> int:
        """Rows of a layer, or those that meet ``column=value``."""
        df = self.layers[layer]
        return (df.where(parse_filter(condition)) if condition else df).count()

    def column(self, layer: str, name: str, condition: str | None = None) -> DataFrame:
        """One column as doubles."""
        df = self.layers[layer]
        return (df.where(parse_filter(condition)) if condition else df).select(F.col(f"`{name}`").cast("double").alias(name))

    def describe(self, layer: str) -> DataFrame:
        return profile(self.layers[layer])


def drop_layer(spark: SparkSession, path: str, layer: str) -> bool:
    """Deletes a layer's files; whether there were any."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{layer}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def list_layers(spark: SparkSession, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def combine(cities: dict[str, DataFrame], key: str, sample: bool = True) -> DataFrame:
    """One layer of many cities with a ``city`` column; by default at most 10 000 rows of each (the feature of a sample)."""
    whole = union_all([df.withColumn("city", F.lit(name)) for name, df in sorted(cities.items())])
    return sample_groups(whole, "city", key) if sample else whole


def read_city_list(spark: SparkSession, path: str) -> DataFrame:
    """The CSV list of cities; lines that begin with ``#`` are left out."""
    schema = "City string, Country string, West double, South double, East double, North double, Population double"
    return spark.read.csv(path, schema=schema, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_partitioned(spark: SparkSession, path: str, theme: str, kind: str) -> DataFrame:
    """A dataset below ``theme=/type=`` directories; the two are partition filters, so other directories are not listed into the scan."""
    return spark.read.option("basePath", path).parquet(path).where((F.col("theme") == theme) & (F.col("type") == kind))


def tiles_of(extents: DataFrame, tiles: DataFrame) -> DataFrame:
    """Distinct ids of tiles whose box meets that of an extent (the index of tiles is a small fixed table)."""
    t = F.broadcast(tiles.select("tile_id", *(F.col(c).alias("t_" + c) for c in ("minx", "miny", "maxx", "maxy"))))
    meet = (F.col("t_minx") <= F.col("maxx")) & (F.col("minx") <= F.col("t_maxx")) & (F.col("t_miny") <= F.col("maxy")) & (F.col("miny") <= F.col("t_maxy"))
    return extents.join(t, meet).select("tile_id").distinct()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_npz(path: str, **grids) -> None:
    """Arrays of one city's grid in one file on the driver."""
    import numpy as np

    np.savez_compressed(path, **grids)


def write_templates(df: DataFrame, key: str, folder: str) -> DataFrame:
    """One JSON document for each key, in directories ``name=cluster_<key>``; what was written comes back as ``name, json``."""
    names = F.concat(F.lit("cluster_"), file_name(F.col(key).cast("string")))
    out = df.select(names.alias("name"), F.to_json(F.struct(*df.columns)).alias("json"))
    out.write.mode("overwrite").partitionBy("name").text(folder)
    return out


def template(name: str, histograms: dict) -> str:
    return json.dumps({"name": name, "histograms": histograms}, sort_keys=True)


class Locked(RuntimeError):
    """Another run holds the city."""


class Lock:
    """A file beside the layers that says what is going on; created atomically by the file system.

    ``against`` names the reasons that block this one. A download blocks
    processing, and both block contextualizing.
    """

    BLOCKS = {"PROCESS": ("DOWNLOAD",), "CONTEXTUALIZE": ("DOWNLOAD", "PROCESS"), "DOWNLOAD": ("DOWNLOAD",)}

    def __init__(self, spark: SparkSession, path: str, reason: str) -> None:
        self.reason = reason
        self._paths = {r: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_{r.lower()}.lock") for r in self.BLOCKS}
        self._fs = self._paths[reason].getFileSystem(spark._jsc.hadoopConfiguration())

    def __enter__(self) -> Lock:
        held = [r for r in self.BLOCKS[self.reason] if self._fs.exists(self._paths[r])]
        if held:
            raise Locked(f"held for {', '.join(held)}")
        if not self._fs.createNewFile(self._paths[self.reason]):
            raise Locked(f"held for {self.reason}")
        return self

    def __exit__(self, *_) -> None:
        self._fs.delete(self._paths[self.reason], False)
