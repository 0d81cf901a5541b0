"""The test tables as logical tables, by fixed rules (see the README)."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import content_hash, fixed_windows

NOW = datetime(2024, 1, 8, tzinfo=UTC)
EPOCH = "timestamp '2024-01-01 00:00:00'"
NUMBER = r"cast(coalesce(nullif(regexp_extract({c}, '([0-9]+)$', 1), ''), '0') as int)"
TYPES = ["git", "fs", "confluence", "slack"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per distinct documents.source; type, SLA, tenant and last sync follow from the number in its name."""
    names = table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.expr(NUMBER.format(c="first(source)")).alias("n"))
    return names.select(
        F.md5("name").alias("id"), "name", F.element_at(F.array(*map(F.lit, TYPES)), F.col("n") % 4 + 1).alias("type"),
        F.when(F.col("n") % 3 != 0, (F.col("n") * 20000).cast("long")).alias("freshness_sla_seconds"),
        F.when(F.col("n") % 5 != 0, F.expr(f"{EPOCH} + make_dt_interval(0, n * 10)")).alias("last_sync_at"),
        F.when(F.col("n") % 2 == 1, F.concat(F.lit("tenant"), F.col("n") % 3)).alias("tenant_id"),
    )


def documents(spark: SparkSession, sf_dir: str, *, hashed: bool = False) -> DataFrame:
    """A row per document: indexed a minute after the one before, every 17th tombstoned an hour later."""
    d = table(spark, sf_dir, "documents")
    out = d.select(
        F.col("doc_id").cast("string").alias("id"), F.md5("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"),
        F.concat(F.lit("doc://"), "source", F.lit("/"), "doc_id").alias("uri"), F.concat("source", F.lit(" #"), "doc_id").alias("title"),
        (F.col("doc_id") % 3 + 1).alias("doc_version"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
        F.expr(f"{EPOCH} + make_dt_interval(0, 0, cast(doc_id % 20000 as int))").alias("indexed_at"),
        F.when(F.col("doc_id") % 17 == 0, F.expr(f"{EPOCH} + make_dt_interval(0, 1, cast(doc_id % 20000 as int))")).alias("tombstoned_at"),
        *([content_hash(F.col("text")).alias("content_hash")] if hashed else []),
    )
    return out


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of the same chunks."""
    c = fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return c.select(F.concat("doc_id", F.lit(":"), "ord").alias("id"), F.col("chunk_text").alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows of 512 words; the first of a document has the embedding of the same number."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    c = fixed_windows(d).select(F.concat("doc_id", F.lit(":"), "ord").alias("id"), F.col("doc_id").cast("string").alias("document_id"), "ord", F.col("chunk_text").alias("text"), "lang", "doc_id")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("ord"), "embedding")
    joined = c.join(v, ["doc_id", "ord"], "left")
    return joined.select(
        "id", "document_id", "ord", "text", "embedding", F.lit(None).cast("string").alias("symbol"), F.concat(F.lit("run"), F.col("doc_id") % 5).alias("ingestion_run_id"),
        F.lit("hash-64").alias("embedding_model"), F.lit("hash").alias("embedding_provider"), F.concat(F.lit("v"), F.col("doc_id") % 2).alias("parser_version"),
        F.lit("fixed_window").alias("chunker_strategy"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers, each table a source; customers and suppliers have chunks."""

    def rows(name: str, key: str, label: str, kind: str, chunk: bool) -> DataFrame:
        t = table(spark, sf_dir, name)
        at = F.concat(F.col(key), F.lit(":0")) if chunk else F.lit(None).cast("string")
        return t.select(F.concat(F.lit(f"{name}/"), F.col(key)).alias("id"), F.lit(name).alias("source_id"), F.lit(kind).alias("entity_type"), F.col(label).alias("name"), F.element_at(F.split(F.col(label), "[# ]"), 1).alias("display_name"), at.alias("chunk_id"))

    out = rows("region", "r_regionkey", "r_name", "region", False).unionByName(rows("nation", "n_nationkey", "n_name", "nation", False))
    return out.unionByName(rows("customer", "c_custkey", "c_name", "customer", True)).unionByName(rows("supplier", "s_suppkey", "s_name", "supplier", True))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as ``depends_on`` edges: nation to region, customer and supplier to nation."""

    def rows(name: str, key: str, parent: str, ref: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}/"), F.col(key)).alias("source_entity_id"), F.concat(F.lit(f"{parent}/"), F.col(ref)).alias("target_entity_id"), F.lit("depends_on").alias("edge_type"))

    return rows("nation", "n_nationkey", "region", "n_regionkey").unionByName(rows("customer", "c_custkey", "nation", "c_nationkey")).unionByName(rows("supplier", "s_suppkey", "nation", "s_nationkey"))


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as document changes: (source_type, external_id, action, at, delivery_id, run_id)."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "deleted").otherwise("updated")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("external_id"), action.alias("action"), F.concat(F.lit("run-"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), F.element_at(F.array(*map(F.lit, TYPES)), (F.col("user_id") % 4 + 1).cast("int")).alias("source_type"), "value")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per day and source type."""
    e = change_events(spark, sf_dir)
    r = e.groupBy("run_id", "source_type").agg(F.min("at").alias("started_at"), F.max("at").alias("finished_at"), F.count_if(F.col("action") == "error").alias("n_errors"))
    return r.select(F.concat("run_id", F.lit("/"), "source_type").alias("id"), F.col("source_type").alias("source_id"), "started_at", "finished_at", F.when(F.col("n_errors") > 0, "partial").otherwise("ok").alias("status"))
