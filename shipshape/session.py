"""Session construction and the shared scratch location."""
from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, partitions: int | None = None,
                app: str = "shipshape") -> SparkSession:
    """Create (or reuse) a session with AQE on and the UI off.

    On a cluster ``master`` stays ``None`` and the cluster manager's settings win;
    shuffle width is then left to AQE partition coalescing.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset and everything runs in one JVM (``local[*]``, as in tests) a
    private temporary folder is registered; any other master gets a clear error, since
    a machine-local folder would lose the files of other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors "
                               "share (for example on HDFS or an object store) before starting the session")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shipshape-ckpt-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh sub-folder name under the shared folder."""
    return f"{shared_dir(spark)}/{name or 'scratch'}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Registers the shared folder for ``checkpoint()`` where the context has none yet."""
    base = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as parquet to the shared folder and reads it back: the lineage is cut,
    so a lost executor costs a reread, and later plans prune columns of the files."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _zip(app_id: str) -> str:
    """This package as a zip for the executors; the driver serves it from its own disk."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="shipshape-zip-"), "shipshape-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "shipshape")):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    return path


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor."""
    spark.sparkContext.addPyFile(_zip(spark.sparkContext.applicationId))
