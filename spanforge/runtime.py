"""The folder that all machines share, and the way of this package's code to them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir), with reliable checkpoints going there too.

    Only where the session names none, as in tests on one machine, a temporary folder is made."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if not current.isDefined():
        made = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir(made)
        current = sc._jsc.sc().getCheckpointDir()
    return os.path.dirname(current.get())


def shared_uri(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder, for tables that Spark writes there; of any file system that Hadoop knows."""
    base = shared_dir(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/{kind}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder of the file system in the shared folder, for files that workers map into memory."""
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    if "://" in base:
        raise ValueError(f"spark.checkpoint.dir must be mounted on every machine, not {base}")
    path = os.path.join(base, f"{kind}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Sends this package to the executors once per application, wherever the driver imported it from.

    Whatever makes a Python function of this package run in workers calls it first."""
    spark = spark or SparkSession.active()
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(shared_path(spark, "code"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
