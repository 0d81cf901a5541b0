"""What the operators share: the word rule, tables in the shared folder, partition counts and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space. ``bytes.split()`` follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on a local master (as in tests), where one
    machine does all the work, a folder in the warehouse if it is unset. A cluster without the setting is refused."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors and gives the planner a true size."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes what :func:`stored` wrote for ``tables``: call it once everything that was read from them is stored itself."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows and bytes of an Arrow batch where Python holds several times what a batch has.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside give Python smaller Arrow batches: less memory on both sides, the same results."""
    before = {k: spark.conf.get(k, None) for k in SMALL_BATCHES}
    try:
        for k, v in SMALL_BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``: a host and its subdomains share a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


#: Links that one task may contract to the end: a bound, whatever the input is; more of them go on in rounds.
ONE_TASK = 500_000
#: Nodes that a partition's contraction holds at once.
HELD = 1_000_000


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of a partition as stars around the least node of each component that they form: union-find with
    at most about HELD nodes at once; what is held is put out when there are more, and the rest starts anew."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(x, r) for x in list(root) if (r := find(x)) != x]
        for at in range(0, len(rows), 50_000):
            a, b = zip(*rows[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        root.clear()

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > HELD:
            yield from out()
    yield from out()


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = stored, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of ``edges`` (a, b; long): (node, root) with the smallest node as root, for every node on an edge.

    Each partition's links are contracted to stars first. If at most ``one_task`` are left, one task contracts those (it holds
    two nodes a link at most, so ``one_task`` stays below half of HELD); else large-star and small-star rounds (Kiveris et al., 2014) follow until nothing changes.
    Minima are aggregated and stored before they are joined back, so that no neighbour list is ever gathered and both sides of
    each join are plain shuffles, which AQE splits at hot nodes. Nothing is broadcast. A link of
    a node to itself says nothing.
    """
    both = F.col("a") != F.col("b")
    pair = "a long, b long"
    own = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = keep(own.where(both).mapInArrow(stars, pair), "edges")
    if e.count() <= one_task:
        e = keep(e.coalesce(1).mapInArrow(stars, pair), "edges")
        return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    seen = None
    for _ in range(rounds):
        around = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = around.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(both)
        large = keep(large, "large")
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where(both).distinct()
        old, e = e, keep(small, "edges")
        free(old, low, large, least)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def with_component(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with component_id: the least doc_id of all rows whose ``fp`` has the same root in ``roots`` (node, root).

    Sums are stored before they are joined back, as in ``components``: a large component or a common ``fp`` is split by AQE.
    """
    first = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    known = first.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    known = stored(known, "known")
    least = stored(known.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = stored(known.join(least.hint("merge"), "root").select("fp", "component_id"), "named")
    free(first, known, least)
    return rows.join(named.hint("merge"), "fp").select(*rows.columns, "component_id")
