"""Ingestion: change events to the next state of all tables, as joins over whole batches.

Of a document's events the latest counts. Deletions become tombstones; for the rest contents are fetched, decoded and hashed,
and only changed documents are parsed, chunked, embedded, indexed, put into the graph and linked with other sources. Cost
follows the change, not the corpus, but for the anti joins that keep what didn't change. The state is the same, however a set
of documents is cut into batches: edges that wait for their targets are kept, and links are found from either side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import parsers
from lodestone.functions import text
from lodestone.operators import fulltext, graph, stats, writer
from lodestone.session import free, stored_union

KEY = writer.KEY
#: What of a section's words a chunk has at most, and how far chunks overlap.
MAX_WORDS, OVERLAP = 512, 128


@dataclass(frozen=True)
class Tables:
    """The state. Any table may be empty, none may be left out (:func:`empty` makes them)."""

    documents: DataFrame
    chunks: DataFrame
    postings: DataFrame
    entities: DataFrame
    #: Every edge by its target's name, resolved or not; the resolved ones; those across sources.
    raw_edges: DataFrame
    edges: DataFrame
    links: DataFrame
    #: What entities meet by (see graph.signatures).
    signatures: DataFrame
    #: Whether postings have stems: part of the state, as searches have to ask alike.
    stem: bool = True
    #: Frequent tokens of names, which come last in the signatures; they must stay what they are as long as these.
    common: Mapping[str, int] = field(default_factory=dict)

    def index(self) -> fulltext.Postings:
        """The postings as an index of a search engine."""
        return fulltext.Postings(self.postings, self.stem)

    def graph(self) -> graph.Graph:
        return graph.Graph(self.entities, self.raw_edges, self.edges)


def empty(spark: SparkSession, *, stem: bool = True, common: Mapping[str, int] | None = None) -> Tables:
    """The state before anything was ingested."""
    new = lambda schema: spark.createDataFrame([], schema)
    entities = new("id string, document_id string, source_id string, entity_type string, name string, display_name string, ord string")
    return Tables(
        documents=new("id string, source_id string, external_id string, content_hash string, doc_version long, indexed_at timestamp, tombstoned_at timestamp"),
        chunks=new("id string, document_id string, ord int, text string"), postings=new("chunk_id string, lexeme string, positions array<int>"),
        entities=entities, raw_edges=new("source_entity_id string, target_name string, edge_type string, document_id string"),
        edges=new("source_entity_id string, target_entity_id string, edge_type string, target_name string, document_id string"),
        links=new("source_entity_id string, target_entity_id string, edge_type string, score double, strategy string, linked_source_id string"),
        signatures=graph.signatures(entities, common or {}), stem=stem, common=common or {},
    )


@dataclass(frozen=True)
class Ingested:
    tables: Tables
    #: (run_id, source_id, external_id, action, error, at) of each document that had an event.
    results: DataFrame
    #: A row per run and source: counters and status.
    runs: DataFrame


def latest(events: DataFrame, order: str = "seq") -> DataFrame:
    """Each document's last event by ``order``; of equal ones a deletion counts."""
    if order not in events.columns:
        raise ValueError(f"change events need the column {order}, which orders them")
    rest = [c for c in events.columns if c not in KEY]
    rank = F.struct(F.col(order), (F.col("action") == "deleted").alias("gone"), F.xxhash64(*rest).alias("tie"))
    return events.groupBy(*KEY).agg(F.max_by(F.struct(*rest), rank).alias("e")).select(*KEY, "e.*")


def chunked(parsed: DataFrame) -> DataFrame:
    """Chunks with ``ord`` of parsed documents: code by symbol, Markdown by section, the rest in fixed windows."""
    keep = ["id", "sections"]
    code = text.code_symbol_chunks(parsed.where("content_type = 'text/x-source'").select(*keep), max_words=MAX_WORDS)
    marked = text.markdown_section_chunks(parsed.where("content_type = 'text/markdown'").select(*keep), max_words=MAX_WORDS)
    by_section = text.with_ordinal(code.unionByName(marked), "id").select("id", "ord", F.col("chunk_text").alias("text"), "symbol", "chunker_strategy", "metadata")
    whole = parsed.where("content_type not in ('text/x-source', 'text/markdown')").select("id", F.array_join("sections.text", "\n").alias("whole"))
    windows = text.fixed_windows(whole, text="whole", max_words=MAX_WORDS, overlap=OVERLAP).select("id", "ord", F.col("chunk_text").alias("text"), F.lit(None).cast("string").alias("symbol"), F.lit("fixed_window").alias("chunker_strategy"), F.create_map().cast("map<string,string>").alias("metadata"))
    return by_section.unionByName(windows).withColumnRenamed("id", "document_id")


def ingest(tables: Tables, events: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: datetime, *, run_id: str, embed: Callable[[Column], Column] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df, spend: bool = False) -> Ingested:
    """The tables after ``events`` (source_id, external_id, action, seq, ...).

    ``fetch`` gives (source_id, external_id, path, content_type, content) of the keys it gets; a key it leaves out has failed.
    ``keep`` may store what is used more than once (a checkpoint, a written table). With several batches in one session it has
    to cut the lineage, as each state is made from the one before. What ``session.written`` stored on the way is deleted when
    it isn't read any more. ``tables`` stay, until the caller frees them; with ``spend``, for which ``keep`` has to store, each of
    them goes when what follows it is stored.
    """
    last = keep(latest(events))
    gone = last.where("action = 'deleted'").select(*KEY)
    wanted = last.where("action <> 'deleted'").select(*KEY)
    incoming = fetch(wanted).select(*KEY, "path", "content_type", "content").withColumn("text", text.decode_utf8(F.col("content")))
    judged = writer.actions(tables.documents, incoming).withColumn("content", F.when(F.col("action") != "unchanged", F.col("content")))
    # Fetched once and stored once, and of contents only those that changed.
    judged = keep(judged.select("id", *KEY, "content_hash", "action", "doc_version", "path", "content_type", "content"))
    changed = judged.where("action <> 'unchanged'").select("id", *KEY, "path", "content_type", "content")
    touched = changed.select(F.col("id").alias("document_id"))

    documents = judged.select("id", *KEY, "content_hash", "action", "doc_version", text.decode_utf8(F.col("content")).alias("text"))
    documents, found = writer.tombstone(writer.upsert_judged(tables.documents, documents, now), gone, now)
    done = judged.select(*KEY, "action", F.lit(None).cast("string").alias("error"))
    lost = wanted.join(judged.select(*KEY), KEY, "left_anti").select(*KEY, F.lit("error").alias("action"), F.lit("content could not be fetched").alias("error"))
    removed = found.select(*KEY, F.when(F.col("found"), "deleted").otherwise("unchanged").alias("action"), F.lit(None).cast("string").alias("error"))
    results = done.unionByName(lost).unionByName(removed).select(F.lit(run_id).alias("run_id"), *KEY, "action", "error", F.lit(now).alias("at"))
    documents, results = keep(documents), keep(results)

    # Documents that have no chunk any more lose theirs too. What stays and what is new are stored apart: neither is copied.
    old = tables.chunks.join(touched, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    postings = keep(fulltext.without_chunks(tables.postings, old))
    if spend:
        free(tables.documents, tables.postings)
    chunks = keep(tables.chunks.join(touched, "document_id", "left_anti"))
    if spend:
        free(tables.chunks)
    parsed = keep(parsers.parse_documents(changed.select("id", "path", "content_type", "content")))
    made = chunked(parsed).withColumn("id", F.concat_ws(":", "document_id", "ord")).withColumn("ingestion_run_id", F.lit(run_id))
    made = keep(writer.without_empty(made.withColumn("embedding", embed(F.col("text")))) if embed else made)
    free(parsed)

    entities, raw_edges = parsers.extract_graph(changed.select("id", "path", "content_type", "content"))
    sources = changed.select(F.col("id").alias("document_id"), "source_id")
    entities = keep(entities.dropDuplicates(["id"]).join(sources, "document_id").withColumn("ord", F.col("name")))
    raw_edges = keep(raw_edges)
    left = tables.entities.join(touched, "document_id", "left_semi").select("id")
    after = graph.apply_delta(tables.graph(), entities, raw_edges, touched=touched, keep=keep)
    others = tables.signatures.join(left, "id", "left_anti")
    signed = keep(graph.signatures(entities, tables.common))
    links = writer.cascade(writer.cascade(tables.links, left, "source_entity_id"), left, "target_entity_id")
    links, signatures = keep(links.unionByName(graph.link_delta(others, signed))), keep(others.unionByName(signed))
    free(last, judged, entities, raw_edges, signed)
    if spend:
        free(tables.entities, tables.raw_edges, tables.edges, tables.links, tables.signatures)

    new = keep(fulltext.postings(made.select("id", "text"), id="id", stem=tables.stem))
    state = replace(tables, documents=documents, chunks=stored_union(chunks, made), postings=stored_union(postings, new), entities=after.entities, raw_edges=after.raw, edges=after.edges, links=links, signatures=signatures)
    return Ingested(state, results, stats.track_runs(results))
