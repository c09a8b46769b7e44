"""Intermediate tables and files in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset and Spark runs on one machine
(tests, a laptop) a temporary one is made and set; on a cluster that is an error.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWNER: list[str] = ["query"]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomline/{spark.sparkContext.applicationId}/{_OWNER[-1]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def owner(spark: SparkSession, name: str, clear: bool = True):
    """Tables made inside belong to ``name``; with ``clear``, those it made before are deleted first."""
    _OWNER.append(name)
    try:
        if clear:
            delete(spark, _root(spark))
        yield
    finally:
        _OWNER.pop()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(pyarrow filesystem, path) for a URI of any scheme that pyarrow knows; usable in executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    # Hadoop's names of stores that pyarrow knows by others
    scheme, rest = uri.split("://", 1)
    own = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return fs.FileSystem.from_uri(f"{own}://{rest}")
