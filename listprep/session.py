"""Session used by tests and the benchmark; jobs on a cluster bring their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("listprep")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # no call-site record per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # the JVM never compiles a method of more than 8000 bytes
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
