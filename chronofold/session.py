"""Session helpers: shipping of the package, and scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of the session.

    Where PYTHONPATH already names the package's folder, executors are set up and nothing happens.
    Else a zip of the package is handed to Spark's file server, once per context.
    """
    context = spark.sparkContext
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(_ROOT.parent) in paths or context in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="chronofold-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = shutil.make_archive(f"{folder}/chronofold", "zip", root_dir=_ROOT.parent, base_dir=_ROOT.name)
    context.addPyFile(made)
    _shipped[context] = made


_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Unset, a temporary folder is used in local mode only; on a cluster that is an error, as
    executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith(("local[", "local")) or "cluster" in context.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="chronofold-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str = "") -> str:
    """A new path in the shared folder, deleted when the interpreter ends."""
    path = f"{scratch_dir(spark)}/chronofold/{name}{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage as a reliable checkpoint does, but the file is columnar and
    compressed. A lost executor loses nothing: the files belong to no executor.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table of materialize() that no later step reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _remove(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return
