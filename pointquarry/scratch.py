"""New paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of each application's tables, by its id.
FOLDERS: dict[str, str] = {}
#: Rows up to which a table is sent to all tasks (some 100 bytes each).
FEW = 1 << 16


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A local session that has none gets a temporary folder; elsewhere that raises, as
    executors could not see the driver's folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path, with the scheme of its store, below the application's own folder.

    The folder is made once for an application and removed when its driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_base(spark)}/{app}-{uuid.uuid4().hex}")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        path = store.makeQualified(path)
        store.mkdirs(path)
        store.deleteOnExit(path)
        FOLDERS[app] = path.toString()
    return f"{FOLDERS[app]}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: it is computed once, and no plan grows over rounds."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(rows: DataFrame) -> DataFrame:
    """Rows that all tasks get if there are few of them, and else meet others by key."""
    return F.broadcast(rows) if rows.count() <= FEW else rows
