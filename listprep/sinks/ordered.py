"""List files in list order, and what is on the disk checked against it.

Rows are range-partitioned and sorted by their number, so the files of a folder, by name, follow
each other in the list; no task sees more than its range. Spark numbers files with five digits:
a folder holds at most 100,000 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import PANEL_SIZE
from ..sources.files import SPLIT_ROWS, scan_csv
from ..sources.headers import quoted
from ..storage import materialise
from .files import run_name, write_csv

#: Panel files that one task writes one after the other.
FILES_PER_TASK = 64


def _number(name: str) -> Column:
    return quoted(name).try_cast("bigint")


def write_ordered(df: DataFrame, path: str, number: str, contiguous: bool = True, **options) -> None:
    """CSV files in the order of ``number``; raises when the files do not say the same."""
    write_csv(df.repartitionByRange(_number(number)).sortWithinPartitions(_number(number)), path, **options)
    check_order(df.sparkSession, path, number, contiguous)


def check_order(spark: SparkSession, path: str, number: str, contiguous: bool = True) -> None:
    """Raise unless the numbers of the files, by name, rise, and, if they are contiguous, rise by
    one from row to row and go on where the file before ended."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(SPLIT_ROWS - 1))
    split = {"file": F.input_file_name(), "start": F.expr("input_file_block_start()")}
    rows = scan_csv(spark, path).select(*[c.alias(n) for n, c in split.items()], _number(number).alias("n"), place.alias("place"))
    ahead = F.col("n") - F.col("place")
    parts = rows.groupBy("file", "start").agg(
        F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("n_rows"), F.count("n").alias("numbers"),
        F.min(ahead).alias("least"), F.max(ahead).alias("most"),
    )
    # one row per split of the files
    before = F.lag("last").over(Window.orderBy("file", "start"))
    inside = F.col("n_rows") != F.col("numbers")
    between = F.coalesce(F.col("first") <= before, F.lit(False))
    if contiguous:
        inside = inside | (F.col("least") != F.col("most"))
        between = F.coalesce(F.col("first") != before + 1, F.lit(False))
    wrong = parts.withColumn("wrong", F.coalesce(inside, F.lit(True)) | between).filter("wrong").orderBy("file", "start").first()
    if wrong:
        raise ValueError(f"{wrong['file']} is out of order: numbers {wrong['first']} to {wrong['last']} in {wrong['n_rows']} rows")


def write_final(df: DataFrame, folder: str, manufacturer: str, month: str, year: str, **options) -> str:
    """The final table in list order (K4); returns its path."""
    path = f"{folder}/{run_name(manufacturer, month, year)}_FINAL_OUTPUT"
    write_ordered(df, path, "EXTERNALREFERENCE", **options)
    return path


def write_channels(email: DataFrame, mail: DataFrame, folder: str, base: str, **options) -> list[str]:
    """The e-mail and the mail output, each in list order (K5)."""
    paths = [f"{folder}/{base}_email", f"{folder}/{base}_mail"]
    for df, path in zip((email, mail), paths, strict=True):
        write_ordered(df, path, "SEQUENCE #(8)", contiguous=False, **options)
    return paths


def write_panels(panel_rows: DataFrame, path: str, base: str, size: int = PANEL_SIZE) -> DataFrame:
    """One file of ``size`` rows per chunk, ``{base}_{panel}_panel_{i}_of_{n}.csv`` (K6).

    A task gets whole chunks of a panel, some ``FILES_PER_TASK`` of them in list order, and begins
    a new file after every ``size`` rows. The files get their names when all are there and their
    rows agree; returns the index that was checked: ``name``, ``panel``, ``chunk`` and ``n_rows``.
    """
    spark = panel_rows.sparkSession
    group = F.floor((F.col("panel_row") - 1) / F.lit(size * FILES_PER_TASK))
    ordered = panel_rows.withColumn("_group", group).repartitionByRange("panel", "_group")
    ordered = ordered.sortWithinPartitions("panel", "panel_row").drop("_group", "panel_row", "panel_file", "n_chunks")
    write_csv(ordered, path, partition_by=("panel",), maxRecordsPerFile=size)
    index = materialise(_panel_index(spark, path, base, size), "panel-index")
    # one call per file, as committing took
    _rename(spark, path, index)
    return index.drop("file")


def _panel_index(spark: SparkSession, path: str, base: str, size: int) -> DataFrame:
    number = _number("SEQUENCE #(8)")
    files = scan_csv(spark, path).withColumn("file", F.input_file_name()).groupBy("panel", "file")
    files = files.agg(F.count("*").alias("n_rows"), F.min(number).alias("first"), F.max(number).alias("last"))
    # one row per file of a panel
    by_number = Window.partitionBy("panel").orderBy("first")
    whole = Window.partitionBy("panel")
    index = files.withColumns(
        {"chunk": F.row_number().over(by_number), "of": F.count("*").over(whole), "before": F.lag("last").over(by_number)}
    )
    short = (F.col("chunk") < F.col("of")) & (F.col("n_rows") != size) | (F.col("n_rows") > size)
    wrong = index.filter(short | F.coalesce(F.col("first") <= F.col("before"), F.lit(False))).first()
    if wrong:
        raise ValueError(f"{wrong['file']} is no whole panel file: {wrong['n_rows']} rows")
    name = F.concat_ws("_", F.lit(base), "panel", F.lit("panel"), "chunk", F.lit("of"), "of")
    return index.select(F.concat(name, F.lit(".csv")).alias("name"), "panel", F.col("chunk").cast("long").alias("chunk"), "n_rows", "file")


def _rename(spark: SparkSession, path: str, index: DataFrame) -> None:
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    folder = make(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    moves = [(row["name"], row["panel"], row["file"].rsplit("/", 1)[-1]) for row in index.select("name", "panel", "file").toLocalIterator()]
    for name, panel, file in moves:
        if not system.rename(make(f"{path}/panel={panel}/{file}"), make(f"{path}/{name}")):
            raise OSError(f"cannot name {file} {name}")
    for panel in {panel for _, panel, _ in moves}:
        system.delete(make(f"{path}/panel={panel}"), True)
