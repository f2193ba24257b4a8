"""Session factory with the settings the library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessella", master: str | None = None, partitions: int = 8) -> SparkSession:
    """Return a session: UTC, adaptive execution, Arrow transfer, few shuffle partitions.

    On a cluster leave ``master`` unset; the submit command decides it and
    ``partitions`` should be two to three times the number of cores.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
