"""Sessions and storage that all operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "spindrift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local session (tests) gets a temporary folder of its own; on a cluster it is an error, as executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spindrift-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/spindrift-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "step", compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage of loops, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """Arrow's file system and path of a URI or a plain local path."""
    from pyarrow import fs

    if "://" not in uri:
        if not uri.startswith("file:"):
            return fs.LocalFileSystem(), uri
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def read_table(uri: str):
    """A Parquet folder below the shared folder as an Arrow table, for workers that need all of it."""
    from pyarrow import parquet

    files, path = open_fs(uri)
    return parquet.read_table(path, filesystem=files)


MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


#: Bytes of rows that go to a Python worker at a time, where the session doesn't say.
BATCH_BYTES = "8m"


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers, once a session, unless PYTHONPATH leads them to it; and rows in batches of bounded bytes."""
    if not spark.sparkContext.getConf().contains(MOST_BYTES):
        spark.conf.set(MOST_BYTES, BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spindrift-"), "spindrift.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "spindrift")):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
