"""Inputs of the registered queries and small things the operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="listprep-")) / "listprep-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def arrow_map(df: DataFrame, schema: str | StructType, per_batch: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Apply a function to the Arrow batches of ``df``."""

    ship(df.sparkSession)

    def batches(stream):
        for batch in stream:
            if batch.num_rows:
                yield from per_batch(batch)

    return df.mapInArrow(batches, schema)


def with_first_of(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per key; of rows that repeat a key, the one whose columns sort first."""
    smallest = F.min(F.struct(*columns)).alias("_first")
    return df.groupBy(key).agg(smallest).select(key, *[F.col(f"_first.{name}").alias(name) for name in columns])


def top_ranked(df: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key in ``order``, with their ``rank``; Spark keeps no more
    than ``k`` rows per key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {column.lower() for column in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
