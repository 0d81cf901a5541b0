"""The write path: upserts by hash, tombstones, purges and cascades, as whole-table plans.

A plan returns the table's next state; :func:`swap` publishes it by writing a new version beside the old one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import Conflict
from lodestone.functions.text import content_hash
from lodestone.operators.buckets import BucketTable

KEY = ["source_id", "external_id"]


def document_id() -> Column:
    """The id of a document that isn't stored yet."""
    return F.sha1(F.concat_ws(":", *KEY))


def actions(current: DataFrame, incoming: DataFrame, *, revive: bool = True) -> DataFrame:
    """(id, source_id, external_id, content_hash, action, doc_version) for each incoming document.

    A document keeps its id for life; a new one's is made from its key. New: created, version 1. Same hash: unchanged, unless it is tombstoned and ``revive`` is set. Else updated, version + 1.
    Compared before anything expensive is done with the text.
    """
    c = current.select(*KEY, F.col("id").alias("known"), F.col("content_hash").alias("old"), F.col("doc_version").alias("v"), F.col("tombstoned_at").isNotNull().alias("dead"))
    j = incoming.withColumn("content_hash", content_hash(F.col("text"))).join(c, KEY, "left")
    same = (F.col("content_hash") == F.col("old")) & (~F.col("dead") if revive else F.lit(True))
    action = F.when(F.col("old").isNull(), "created").when(same, "unchanged").otherwise("updated")
    version = F.when(F.col("old").isNull(), F.lit(1)).when(same, F.col("v")).otherwise(F.col("v") + 1).cast("long")
    id = F.coalesce("known", document_id())
    return j.select(id.alias("id"), *[x for x in incoming.columns if x != "id"], "content_hash", action.alias("action"), version.alias("doc_version"))


def upsert_documents(current: DataFrame, incoming: DataFrame, now: datetime, *, revive: bool = True) -> DataFrame:
    """The documents table after an upsert: unchanged rows stay untouched, written ones lose their tombstone."""
    return upsert_judged(current, actions(current, incoming, revive=revive), now)


def upsert_judged(current: DataFrame, judged: DataFrame, now: datetime) -> DataFrame:
    """:func:`upsert_documents` of what :func:`actions` gave for the incoming documents."""
    new = judged.where("action <> 'unchanged'")
    made = ("id", *KEY, "content_hash", "doc_version", "indexed_at", "tombstoned_at")
    rows = new.select("id", *KEY, "content_hash", "doc_version", F.lit(now).alias("indexed_at"), F.lit(None).cast("timestamp").alias("tombstoned_at"), *[c for c in judged.columns if c in current.columns and c not in (*made, "action")])
    return current.join(new.select(*KEY), KEY, "left_anti").unionByName(rows, allowMissingColumns=True)


def upsert_in_buckets(table: BucketTable, incoming: DataFrame, now: datetime, *, revive: bool = True) -> list[int]:
    """:func:`upsert_documents` on a table in buckets of KEY: reads the buckets of ``incoming``, writes those of what changed."""
    current = table.near(incoming)
    new = actions(current, incoming, revive=revive).where("action <> 'unchanged'").select(*KEY)
    after = upsert_documents(current, incoming, now, revive=revive).join(new, KEY, "left_semi")
    return table.replace(new, after)


def replace_chunks(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks after those of ``incoming``'s documents were replaced; an empty embedding is null."""
    return current.join(incoming.select("document_id").distinct(), "document_id", "left_anti").unionByName(without_empty(incoming), allowMissingColumns=True)


def without_empty(chunks: DataFrame) -> DataFrame:
    """``chunks`` with null for an empty embedding."""
    return chunks.withColumn("embedding", F.when(F.size("embedding") > 0, F.col("embedding"))) if "embedding" in chunks.columns else chunks


def tombstone(documents: DataFrame, keys: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(documents with the keys tombstoned at ``now``, keys with ``found``); one that is already dead is found and set anew."""
    marked = documents.join(keys.select(*KEY).distinct().withColumn("__hit", F.lit(True)), KEY, "left")
    out = marked.withColumn("tombstoned_at", F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("tombstoned_at"))).drop("__hit")
    found = keys.join(documents.select(*KEY).distinct().withColumn("found", F.lit(True)), KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return out.select(*documents.columns), found


def purgeable(older_than_seconds: int, now: datetime) -> Column:
    return F.col("tombstoned_at").isNotNull() & (F.col("tombstoned_at") <= F.lit(now) - F.make_dt_interval(secs=F.lit(older_than_seconds)))


def purge(documents: DataFrame, chunks: DataFrame, older_than_seconds: int, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, one row with ``purged``) without tombstones at least so old; chunks cascade."""
    gone = documents.where(purgeable(older_than_seconds, now))
    left = documents.where(~F.coalesce(purgeable(older_than_seconds, now), F.lit(False)))
    ids = gone.select(F.col("id").alias("document_id"))
    return left, chunks.join(ids, "document_id", "left_anti"), gone.agg(F.count(F.lit(1)).alias("purged"))


def cascade(children: DataFrame, parents_gone: DataFrame, key: str) -> DataFrame:
    """Children without those of removed parents (``id``)."""
    return children.join(parents_gone.select(F.col("id").alias(key)), key, "left_anti")


def set_null(children: DataFrame, parents_gone: DataFrame, key: str) -> DataFrame:
    """Children whose parent was removed keep their row with a null key."""
    gone = parents_gone.select(F.col("id").alias("__gone"))
    j = children.join(gone, F.col(key) == F.col("__gone"), "left")
    return j.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).select(*children.columns)


def patch(table: DataFrame, id: str, values: dict) -> DataFrame:
    """A row's given fields set; others stay."""
    return table.withColumns({k: F.when(F.col("id") == id, F.lit(v)).otherwise(F.col(k)).cast(table.schema[k].dataType) for k, v in values.items()})


def _pointers(spark, path: str):
    """(file system, folder of pointers) of a table."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_pointer")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _versions(fs, folder) -> list[str]:
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("n")) if fs.exists(folder) else []


def version(spark, path: str) -> int:
    """The number of a table's latest version; -1 if it has none."""
    have = _versions(*_pointers(spark, path))
    return int(have[-1][1:]) if have else -1


def swap(df: DataFrame, path: str, *, after: int | None = None) -> str:
    """Writes ``df`` as the next version below ``path`` and points readers at it (:func:`current`).

    A pointer is a file named by its number alone, which holds the version's folder. It is only ever created, never written
    over, so that of two writers who want one number the second fails with :class:`Conflict` and has to start from what the
    first has made. ``after`` is the :func:`version` that ``df`` was made from: if there is a later one, ``df`` lacks it, and
    that is a conflict too. The highest number counts, so readers always find a whole version, and a writer that dies leaves
    the one before.
    """
    import uuid

    from py4j.protocol import Py4JJavaError

    spark = df.sparkSession
    folder_name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder_name}")
    fs, folder = _pointers(spark, path)
    fs.mkdirs(folder)
    last = version(spark, path)
    if after is not None and last != after:
        raise Conflict(f"{path} has version {last}, not {after}", version=last)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_pointer/n{last + 1:019d}")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise Conflict(f"another writer has made version {last + 1} of {path}", version=last + 1) from e
        raise
    out.write(bytearray(folder_name.encode()))
    out.close()
    return f"{path}/{folder_name}"


def current(spark, path: str) -> DataFrame:
    """A table's latest version. A pointer that its writer didn't finish is passed over."""
    fs, folder = _pointers(spark, path)
    jvm = spark.sparkContext._jvm
    for name in reversed(_versions(fs, folder)):
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
        held = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if held:
            return spark.read.parquet(f"{path}/{held}")
    raise FileNotFoundError(path)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with ``rows`` whose id it doesn't have; columns that they lack are null."""
    return table.unionByName(rows.join(table.select("id"), "id", "left_anti"), allowMissingColumns=True)


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    """``table`` without the rows of ``ids`` (id); children follow by :func:`cascade` or :func:`set_null`."""
    return table.join(ids.select("id"), "id", "left_anti")
