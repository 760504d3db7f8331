"""Session defaults and the shared folder that intermediate tables go to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "rulefold", **conf: str) -> SparkSession:
    """A local session with the settings the library expects (UTC, adaptive execution).

    On a cluster the session comes from spark-submit; nothing in the library depends on this builder.
    """
    parallel = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on this machine for a
    local master (tests); a RuntimeError on a cluster, whose executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="rulefold-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to a fresh table in the shared folder and read it back: lineage is cut and executors may be lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables that stored() made (others are left alone). What is still to be computed from them fails, so this
    is for tables whose readers have been stored themselves."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            removed(table.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark knows; nothing happens if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
