"""Stage tables written once per session to the shared folder.

The reference hands stage 1 to stage 2 and stage 2 to the model notebook as files. Here the fixture
tables and the stage outputs are written as parquet in the folder that the cluster shares the first
time a query needs them and read back afterwards: the lineage is cut, a lost executor costs a
re-read instead of a re-run of the whole chain, and later queries get column pruning and filter
pushdown. A stage belongs to the input files as they are (paths, sizes, times of change); the files
of all stages are deleted by ``release`` or at the end of the program.
"""
from __future__ import annotations

import atexit
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shipshape.session import scratch_dir

_PATHS: dict[tuple, str] = {}
_VALUES: dict[tuple, object] = {}


def _files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of change of the tables in a folder."""
    fs, path = _files(spark, sf_dir)
    out = []
    for s in fs.listStatus(path):
        parts = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        out += [(p.getPath().toString(), p.getLen(), p.getModificationTime()) for p in parts]
    return tuple(sorted(out))


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return spark.sparkContext.applicationId, sf_dir.rstrip("/"), signature(spark, sf_dir), name


def materialized(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage ``name`` over the tables in ``sf_dir``, built on first use."""
    key = _key(spark, sf_dir, name)
    if key not in _PATHS:
        path = scratch_dir(spark, f"stage-{name}")
        build().write.parquet(path)
        _PATHS[key] = path
        if len(_PATHS) == 1:
            atexit.register(release, spark)
    return spark.read.parquet(_PATHS[key])


def remembered(spark: SparkSession, sf_dir: str, name: str, compute: Callable[[], object]):
    """A few values computed once per session, as the median and the bounds."""
    key = _key(spark, sf_dir, name)
    if key not in _VALUES:
        _VALUES[key] = compute()
    return _VALUES[key]


def release(spark: SparkSession) -> None:
    """Deletes all stage files and forgets the values; later queries build their stages anew."""
    paths = list(_PATHS.values())
    _PATHS.clear()
    _VALUES.clear()
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    for p in paths:
        fs, path = _files(spark, p)
        fs.delete(path, True)
