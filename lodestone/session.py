"""The Spark session that the engine expects."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import ConfigError

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app: str = "lodestone", **conf: str) -> SparkSession:
    """A session with CONF; the master and sizes come from spark-submit or ``conf``."""
    builder = SparkSession.builder.appName(app)
    for key, value in (CONF | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on a local master without it one in the warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Shuffle files of a query go when it ends, not when the driver's garbage collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: it is computed once, and lost executors don't matter to it. Only the
    written rows take disk, compressed, until :func:`free` or the driver's end."""
    path = scratch(df.sparkSession, "written")
    with swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = (path,)
    return out


def stored_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both tables' rows by name, without a copy of either; :func:`free` deletes both."""
    out = left.unionByName(right, allowMissingColumns=True)
    out._stored_at = (*getattr(left, "_stored_at", ()), *getattr(right, "_stored_at", ()))
    return out


def free(*tables: object) -> None:
    """Deletes what :func:`written` stored for ``tables``, once everything that is read from them is stored itself; others stay."""
    for t in tables:
        for path in getattr(t, "_stored_at", ()) if isinstance(t, DataFrame) else ():
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
