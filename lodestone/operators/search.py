"""Search: request, strategies, enrichment and statistics. One request is one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import DocumentNotFound, InvalidRequest
from lodestone.operators import filters, fulltext, fusion, graph, vector

#: Phrases of relationship queries, by substring; quoted and code-like queries are looked up by keyword. Fixed values.
STRUCTURAL_PHRASES = [
    "depends on", "depend on", "dependencies of", "dependency of", "imports", "imported by", "calls", "called by", "references", "referenced by",
    "uses", "used by", "inherits from", "extends", "what calls", "what imports", "what depends", "who calls", "who imports", "who uses",
]
QUOTED, CODE = r"""["'](.+?)["']""", r"\b[A-Z][A-Z0-9_]{2,}\b"
#: Leading phrases that a subject follows, first match. Fixed values.
SUBJECT_PREFIXES = [
    "what depends on ", "what imports ", "what calls ", "who calls ", "who imports ", "who uses ", "depends on ", "depend on ", "dependencies of ", "dependency of ",
    "imported by ", "called by ", "referenced by ", "references to ", "calls ", "imports ", "uses ", "inherits from ", "extends ",
]
STRATEGIES = ["hybrid", "keyword", "structural", "auto"]
SEED_SCORE, NEIGHBOUR_SCORE, MAX_SEEDS = 1.0, 0.7, 10


def classify(query: Column) -> Column:
    """``structural``, ``keyword`` or ``hybrid`` for each query of a log."""
    lower = F.lower(query)
    phrase = F.exists(F.array(*map(F.lit, STRUCTURAL_PHRASES)), lambda p: lower.contains(p))
    return F.when(phrase, "structural").when(query.rlike(QUOTED) | query.rlike(CODE), "keyword").otherwise("hybrid")


def subject(query: Column) -> Column:
    """What a relationship query is about: what follows the first leading phrase, else the last word."""
    from lodestone.functions.text import split_words

    out = F.when(F.lit(False), query)
    for p in SUBJECT_PREFIXES:
        out = out.when(F.lower(query).startswith(p), F.trim(F.substr(query, F.lit(len(p) + 1))))
    return out.otherwise(F.coalesce(F.try_element_at(split_words(query), F.lit(-1)), query))


@dataclass(frozen=True)
class SearchRequest:
    query: str
    top_k: int = 10
    sources: Sequence[str] = ()
    types: Sequence[str] = ()
    max_age_seconds: int | None = None
    filters: Mapping[str, Any] = field(default_factory=dict)
    include_tombstoned: bool = False
    strategy: str = "hybrid"
    workspace_id: str | None = None
    #: Filters before candidates are chosen, so that top_k rows come back if there are so many.
    prefilter: bool = False

    def __post_init__(self):
        if not 1 <= self.top_k <= 500:
            raise InvalidRequest("top_k must be between 1 and 500")
        if self.max_age_seconds is not None and self.max_age_seconds < 1:
            raise InvalidRequest("max_age_seconds must be at least 1")


@dataclass
class SearchResult:
    hits: DataFrame
    #: One row: total_matches_before_filters, vector_matches, text_matches.
    stats: DataFrame


def clauses(request: SearchRequest, now: datetime) -> list[Column | None]:
    """In order: names, types, age, tombstones, metadata."""
    return [
        filters.any_of("source_name", request.sources),
        filters.any_of("source_type", request.types),
        filters.fresh("indexed_at", request.max_age_seconds, now),
        filters.live("tombstoned_at", request.include_tombstoned),
        filters.metadata_contains("metadata", request.filters),
    ]


def enrich(candidates: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, *, bounded: bool = True) -> DataFrame:
    """Candidates (chunk_id, score) with their chunk, document and source.

    A ``bounded`` list is a top-N result of at most 1,000 rows, so it is the side to broadcast; others are joined as Spark
    finds best (a graph's hub may have any number of neighbours).
    """
    small = F.broadcast if bounded else lambda df: df
    c = chunks.withColumnRenamed("id", "chunk_id").select("chunk_id", "document_id", "ord", "text", "symbol", "ingestion_run_id", "embedding_model", "embedding_provider", "parser_version", "chunker_strategy", "metadata")
    found = c.join(small(candidates), "chunk_id")
    d = documents.select(F.col("id").alias("document_id"), "source_id", "uri", "title", "indexed_at", "doc_version", "tombstoned_at")
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("type").alias("source_type"), *[x for x in ("workspace_id", "tenant_id") if x in sources.columns])
    return d.join(small(found), "document_id").join(s, "source_id")


def hit_columns(default_score: float = 0.0) -> list[Column]:
    """A hit with nested source, citation and lineage."""
    return [
        F.col("chunk_id"),
        F.col("document_id"),
        F.coalesce("score", F.lit(default_score)).alias("score"),
        F.col("text"),
        F.struct(F.col("source_id").alias("id"), F.col("source_name").alias("name"), F.col("source_type").alias("type")).alias("source"),
        F.struct("uri", "title", "indexed_at", "doc_version").alias("citation"),
        F.struct("ingestion_run_id", "embedding_model", "embedding_provider", "parser_version", "chunker_strategy").alias("lineage"),
        F.col("metadata"),
    ]


class Engine:
    """Search and lookups over the logical tables. ``embed`` gives a query's vector; ``index`` is a postings table or a written
    index, ``cells`` a written vector index; without them the chunks are scanned. Words are reduced to English stems as the
    index's are, if it knows (another ``stem`` is refused), else unless ``stem`` is false."""

    def __init__(self, *, sources: DataFrame, documents: DataFrame, chunks: DataFrame, embed: Callable[[str], Sequence[float]], entities: DataFrame | None = None, edges: DataFrame | None = None, reranker: Callable[[Column], Column] | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC), stem: bool | None = None, index: fulltext.Index | None = None, cells: vector.CellIndex | None = None):
        self.sources, self.documents, self.chunks, self.cells = sources, documents, chunks, cells
        self.index = fulltext.Texts(chunks, id="id") if index is None else index
        self.embed, self.entities, self.edges, self.reranker, self.now, self.stem = embed, entities, edges, reranker, now, fulltext.stemmed(self.index, stem, default=True)

    def select_strategy(self, request: SearchRequest) -> str:
        """``auto`` by the classifier's rules; an unknown name is hybrid."""
        if request.strategy != "auto":
            return request.strategy if request.strategy in STRATEGIES else "hybrid"
        import re

        if any(p in request.query.lower() for p in STRUCTURAL_PHRASES):
            return "structural"
        return "keyword" if re.search(QUOTED, request.query) or re.search(CODE, request.query) else "hybrid"

    def search(self, request: SearchRequest) -> SearchResult:
        strategy = self.select_strategy(request)
        scope = self
        if request.prefilter:
            scope = self._narrowed(request)
        if strategy == "keyword":
            return scope._keyword(request)
        if strategy == "structural" and self.entities is not None:
            return scope._structural(request)
        return scope._hybrid(request)

    def _narrowed(self, request: SearchRequest) -> Engine:
        kept = filters.apply(self._joined(), *clauses(request, self.now())).select("chunk_id")
        out = Engine(**{k: getattr(self, k) for k in ("sources", "documents", "chunks", "index", "embed", "entities", "edges", "reranker", "now", "stem")})
        out.chunks, out.cells = self.chunks.join(kept, self.chunks["id"] == kept["chunk_id"], "left_semi"), None
        rows = self.index if isinstance(self.index, DataFrame) else self.index.rows if isinstance(self.index, fulltext.Postings) else None
        out.index = fulltext.Texts(out.chunks, id="id") if rows is None else fulltext.Postings(rows.join(kept, "chunk_id", "left_semi"), self.stem)
        return out

    def _joined(self) -> DataFrame:
        c = self.chunks.withColumnRenamed("id", "chunk_id")
        d = self.documents.select(F.col("id").alias("document_id"), "source_id", "indexed_at", "tombstoned_at")
        s = self.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("type").alias("source_type"))
        return c.join(d, "document_id").join(s, "source_id")

    def _finish(self, request: SearchRequest, candidates: DataFrame, limit: int, default: float = 0.0, bounded: bool = True) -> DataFrame:
        sources = filters.workspace(self.sources, request.workspace_id)
        rows = filters.apply(enrich(candidates, self.chunks, self.documents, sources, bounded=bounded), *clauses(request, self.now()))
        return rows.select(*hit_columns(default)).orderBy(F.desc("score"), "chunk_id").limit(limit)

    def _hybrid(self, request: SearchRequest) -> SearchResult:
        pool = 50 if self.reranker else request.top_k
        q = self.embed(request.query)
        by_vector = self.cells.nearest(q, 2 * pool) if self.cells else vector.nearest(self.chunks.withColumnRenamed("id", "chunk_id"), q, 2 * pool)
        by_text = fulltext.search(self.index, request.query, 2 * pool, stem=self.stem)
        hits = self._finish(request, fusion.reciprocal_rank_fusion([by_vector, by_text]), pool)
        if self.reranker:
            hits = fusion.rerank(hits, self.reranker, q, request.top_k)
        return SearchResult(hits, stats(by_vector, by_text))

    def _keyword(self, request: SearchRequest) -> SearchResult:
        by_text = fulltext.search(self.index, request.query, 2 * request.top_k, stem=self.stem)
        return SearchResult(self._finish(request, by_text, request.top_k), stats(None, by_text))

    def _structural(self, request: SearchRequest) -> SearchResult:
        term = self.entities.sparkSession.range(1).select(F.lit(request.query).alias("q")).select(subject(F.col("q"))).first()[0]
        scored = graph.structural_candidates(self.entities, self.edges, term)
        if scored.isEmpty():
            return self._hybrid(replace(request, strategy="hybrid"))
        return SearchResult(self._finish(request, scored, request.top_k, 0.5, bounded=False), stats(None, scored))

    def get_document(self, document_id: str) -> tuple[DataFrame, DataFrame]:
        """A document, tombstoned or not, and its chunks in order."""
        doc = self.documents.where(F.col("id") == document_id)
        if doc.isEmpty():
            raise DocumentNotFound(f"no document {document_id!r}")
        return doc, self.chunks.where(F.col("document_id") == document_id).orderBy("ord")

    def lineage(self, **by: str) -> DataFrame:
        """Chunks by ingestion_run_id, embedding_model, embedding_provider, parser_version or chunker_strategy."""
        return filters.apply(self.chunks, *[F.col(k) == v for k, v in by.items()])


def stats(by_vector: DataFrame | None, by_text: DataFrame) -> DataFrame:
    """Sizes of the candidate lists and of their union, before filters."""
    sides = [by_text.select("chunk_id", F.lit("text").alias("leg"))] + ([by_vector.select("chunk_id", F.lit("vector").alias("leg"))] if by_vector is not None else [])
    every = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return every.agg(F.count_distinct("chunk_id").alias("total_matches_before_filters"), F.count_if(F.col("leg") == "vector").alias("vector_matches"), F.count_if(F.col("leg") == "text").alias("text_matches"))
