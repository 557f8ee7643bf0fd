"""What the package asks of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_ESTIMATED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def broadcast_by_measure(spark: SparkSession) -> None:
    """No side of a join is broadcast on an estimate any more, only one that adaptive execution has measured.

    Spark estimates a side from the bytes of its files, which says little here:
    a lattice's column packs a hundredfold, and exploded rows are not counted,
    so that an estimate of some megabytes can be gigabytes in the driver. The
    session's limit stays and holds for measured sizes; joins that ask for a
    broadcast themselves are untouched. Without adaptive execution nothing is
    measured, and the session is left alone.
    """
    limit = spark.conf.get(_ESTIMATED)
    if limit == "-1" or spark.conf.get("spark.sql.adaptive.enabled") != "true":
        return
    if spark.conf.get(_MEASURED, None) is None:
        spark.conf.set(_MEASURED, limit)
    spark.conf.set(_ESTIMATED, "-1")
