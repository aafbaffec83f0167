"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "specmill", **conf: str) -> SparkSession:
    """A session for tests and local benchmarks. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        # Call-site capture costs more than the small local jobs themselves.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the setting is missing and the master is local is a folder of this machine
    used; on a cluster a missing setting is an error, because data written there
    would be lost with its executor.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="specmill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


# Paths made inside the open scopes of this thread, innermost last.
_scopes = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession):
    """Removes, at its end, the scratch tables made inside it in this thread, unless they were made to last."""
    opened = _scopes.__dict__.setdefault("paths", [])
    opened.append([])
    try:
        yield
    finally:
        for path in opened.pop():
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A fresh path below the shared folder."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    if not lasting and _scopes.__dict__.get("paths"):
        _scopes.paths[-1].append(path)
    return path


def settled(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back; a ``lasting`` table outlives the scope it is made in.

    Cuts lineage reliably: lost executors re-read the table and never repeat what
    produced it. Used where that work is iterative, costly or not repeatable.
    """
    path = scratch_path(df.sparkSession, name, lasting)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
