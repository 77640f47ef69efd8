"""Tables written once and read by several later steps.

A written table cuts the lineage, survives the loss of executors and keeps column pruning
for whoever reads it back. It goes to the folder the session names in
``spark.checkpoint.dir``, which has to be shared by all executors. Without that setting a
session on a ``local`` master gets a temporary folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
SETTLE_SECONDS = 1.0
MACHINE_LOCAL = ("/tmp", "/var/tmp", "/local_disk0")
_own_folders: dict[str, str] = {}


def working_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a machine's own folder is refused on a cluster."""
    folder = spark.conf.get(SETTING, None)
    local = spark.conf.get("spark.master", "").startswith("local")
    if folder:
        if not local and _machine_local(folder, _default_scheme(spark)):
            raise ValueError(f"{SETTING} names {folder}, which other machines cannot reach")
        return folder.rstrip("/")
    if not local:
        raise ValueError(f"set {SETTING} to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="listprep-")
    return _own_folders[application]


def _default_scheme(spark: SparkSession) -> str:
    """The scheme of paths that name none."""
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(configuration).getScheme()


def _machine_local(folder: str, default: str = "file") -> bool:
    scheme, _, path = folder.rpartition(":")
    path = "/" + path.lstrip("/")
    return (scheme or default) == "file" and any(path == top or path.startswith(f"{top}/") for top in MACHINE_LOCAL)


def application_dir(spark: SparkSession) -> str:
    return f"{working_dir(spark)}/listprep/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own; all paths of one application are under one folder."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the working folder and return a scan of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted now, not when the driver next runs short of
    memory: Spark's cleaner removes them once no plan refers to them any more. The listeners let
    go of a plan some time after its job, hence the second collection."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(SETTLE_SECONDS)


def drop(table: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, after its last reader."""
    for name in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the tables this application wrote; frames that read them are of no use afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
