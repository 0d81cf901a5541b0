"""Counts, freshness, runs, histograms and health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the stage histogram in seconds (fixed values).
STAGE_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]


def active_documents(documents: DataFrame) -> DataFrame:
    return documents.where("tombstoned_at is null").groupBy("source_id").agg(F.count(F.lit(1)).alias("active_documents"))


def document_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("total_documents"), F.count_if(F.col("tombstoned_at").isNull()).alias("active_documents"))


def chunk_counts(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Both readings: ``active_chunks`` of live documents, ``total_chunks`` of all. Chunks are counted before they are joined."""
    per_document = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    d = documents.select(F.col("id").alias("document_id"), "source_id", "tombstoned_at")
    joined = per_document.join(d, "document_id")
    return joined.groupBy("source_id").agg(F.sum("n").alias("total_chunks"), F.coalesce(F.sum(F.when(F.col("tombstoned_at").isNull(), F.col("n"))), F.lit(0).cast("long")).alias("active_chunks"))


def is_stale(sla_seconds: Column, last_sync: Column, now: datetime) -> Column:
    """With an SLA: never synced, or longer ago than it (strictly)."""
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp(last_sync)
    return F.when(sla_seconds.isNull(), F.lit(False)).when(last_sync.isNull(), F.lit(True)).otherwise(age > sla_seconds)


def list_sources(sources: DataFrame, documents: DataFrame, now: datetime) -> DataFrame:
    counts = active_documents(documents)
    rows = sources.join(counts, sources["id"] == counts["source_id"], "left")
    return rows.select(sources["id"], "name", "type", F.coalesce("active_documents", F.lit(0).cast("long")).alias("document_count"), is_stale(F.col("freshness_sla_seconds"), F.col("last_sync_at"), now).alias("is_stale"))


def latest_run(runs: DataFrame) -> DataFrame:
    """Each source's run that started last; ties by id."""
    columns = [c for c in runs.columns if c != "source_id"]
    picked = runs.groupBy("source_id").agg(F.max_by(F.struct(*columns), F.struct("started_at", "id")).alias("r"))
    return picked.select("source_id", "r.*")


def list_runs(runs: DataFrame, *, source_id: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first; ``limit`` is held between 1 and 200."""
    out = runs if source_id is None else runs.where(F.col("source_id") == source_id)
    out = out if status is None else out.where(F.col("status") == status)
    return out.orderBy(F.desc("started_at"), "id").limit(min(200, max(1, limit)))


def run_errors(results: DataFrame) -> DataFrame:
    """(run_id, source_id, external_id, error): the last error of each document of a run, one row each."""
    return results.where("error is not null").groupBy("run_id", "source_id", "external_id").agg(F.max_by("error", "at").alias("error"))


#: Errors that a run's own row lists; all of them are rows of :func:`run_errors`.
LISTED_ERRORS = 100


def track_runs(results: DataFrame) -> DataFrame:
    """Runs from process results (run_id, source_id, external_id, action, error, at): counters, documents with errors, and
    status: partial with any error of that source, else ok. ``errors`` maps the first LISTED_ERRORS such documents to theirs."""
    last = run_errors(results)
    # The least ids of each task, then of these: no list grows with the errors.
    salted = last.groupBy("run_id", "source_id", F.pmod(F.xxhash64("external_id"), F.lit(64)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list(F.struct("external_id", "error"))), 1, LISTED_ERRORS).alias("some"))
    errors = salted.groupBy("run_id", "source_id").agg(F.sum("n").alias("docs_failed"), F.map_from_entries(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, LISTED_ERRORS)).alias("errors"))
    counts = results.groupBy("run_id", "source_id").agg(
        F.min("at").alias("started_at"), F.max("at").alias("finished_at"),
        F.count_if(F.col("action") == "created").alias("docs_new"), F.count_if(F.col("action") == "updated").alias("docs_updated"), F.count_if(F.col("action") == "deleted").alias("docs_removed"),
    )
    joined = counts.join(errors, ["run_id", "source_id"], "left")
    return joined.withColumn("docs_failed", F.coalesce("docs_failed", F.lit(0).cast("long"))).withColumn("status", F.when(F.col("errors").isNull(), "ok").otherwise("partial"))


def source_stats(sources: DataFrame, documents: DataFrame, chunks: DataFrame, runs: DataFrame, now: datetime) -> DataFrame:
    """Everything about each source in a row: documents, chunks, freshness and its last run."""
    d, c = document_counts(documents), chunk_counts(chunks, documents)
    r = latest_run(runs).select("source_id", F.col("id").alias("last_run_id"), F.col("status").alias("last_run_status"))
    s = sources.select(F.col("id").alias("source_id"), "name", "type", is_stale(F.col("freshness_sla_seconds"), F.col("last_sync_at"), now).alias("is_stale"))
    out = s.join(d, "source_id", "left").join(c, "source_id", "left").join(r, "source_id", "left")
    return out.na.fill(0, ["total_documents", "active_documents", "total_chunks", "active_chunks"])


def histogram(rows: DataFrame, value: str, by: list[str], buckets: list[float] | None = None) -> DataFrame:
    """Cumulative counts (le, n) per ``by``; the last bound is +Inf. One pass, one row per key before they are laid out."""
    bounds = buckets or STAGE_BUCKETS
    counted = rows.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("binf"))
    laid = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("binf").alias("n")))
    return counted.select(*by, F.inline(laid))


def health(checks: DataFrame) -> DataFrame:
    """The worst of checks (name, status): ok, degraded or down."""
    order = F.when(F.col("status") == "ok", 0).when(F.col("status") == "degraded", 1).otherwise(2)
    return checks.agg(F.max(order).alias("worst")).select(F.element_at(F.array(F.lit("ok"), F.lit("degraded"), F.lit("down")), F.coalesce("worst", F.lit(0)) + 1).alias("status"))
