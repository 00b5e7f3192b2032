"""Session and shared-storage helpers.

Lineage is cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``, which every executor can read; losing an executor
therefore never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a private folder only for local masters that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted at the end like a staged table."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing will read any more."""
    path = getattr(df, "staged_at", None)
    if path:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [w for w in _WRITTEN if w[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


SPREAD_BYTES = 16 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over all cores by a unique key, where the scan would leave most of them idle.

    A small file of one row group is one task, however costly the work on its
    rows.  A scan of as many files as there are cores, or with ``SPREAD_BYTES``
    for each core, is taken as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # The files' size: an estimate of the columns chosen takes every text for a short one.
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores, key) if size < cores * SPREAD_BYTES and len(df.inputFiles()) < cores else df


@atexit.register
def _drop_written() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; the folder is the cluster's to clean then
            return


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the driver found it.

    Local workers get its folder on their path; a cluster gets it as an archive.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent.parent
    if sc.master.startswith("local[") or sc.master == "local":
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root), sc.environment.get("PYTHONPATH")]))
        return
    archive = Path(tempfile.mkdtemp(prefix="millrace-ship-")) / "millrace.zip"  # on the driver alone; Spark copies it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "millrace").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
