"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where all runs on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """A path for pyarrow's or Python's own file calls when the shared folder is a mounted one."""
    return uri[len("file://") :] if uri.startswith("file://") else uri[len("file:") :] if uri.startswith("file:") else uri


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: a lost executor costs a reread, not a recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tidemill_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() made, once no later plan reads them."""
    for df in tables:
        path = getattr(df, "_tidemill_path", None)
        if path:
            remove(df.sparkSession, path)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound Arrow batches by bytes, as texts vary widely, unless the session has a bound of its own; a text longer than that is a batch by itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(size))


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its own."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
