"""The entity graph: replacing it, resolving targets, hops, structural candidates and links across sources."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.entities import dice, name_tokens, normalize_name
from lodestone.operators.buckets import BucketTable
from lodestone.session import free, written

#: Entity types that may match by name tokens (fixed values).
TERRAFORM = ["terraform_resource", "terraform_module", "resource"]
KUBERNETES = ["k8s_resource", "service", "deployment"]
DASHBOARDS = ["dashboard", "grafana_dashboard"]
THRESHOLD = 0.5
CROSS_REF = "cross_ref"


def name_map(entities: DataFrame, order: str = "ord", wanted: DataFrame | None = None) -> DataFrame:
    """(target_name, entity_id): the last entity of a full name, else the first of a display name; equals of ``order`` by id.

    ``wanted`` (target_name, distinct) limits it to these names. So it depends on the entities alone, not on how they came.
    """
    at = F.struct(order, "id")

    def carriers(column: str) -> DataFrame:
        named = entities.select(F.col(column).alias("target_name"), "id", order)
        return named if wanted is None else named.join(wanted, "target_name", "left_semi")

    full = carriers("name").groupBy("target_name").agg(F.max_by("id", at).alias("by_name"))
    short = carriers("display_name").groupBy("target_name").agg(F.min_by("id", at).alias("by_display"))
    return full.join(short, "target_name", "full").select("target_name", F.coalesce("by_name", "by_display").alias("entity_id"))


def resolve_edges(edges: DataFrame, entities: DataFrame, *, carry: list[str] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Edges (source_entity_id, target_name, edge_type) with target ids and the columns ``carry``; unresolved ones and self-loops go."""
    joined = edges.join(name_map(entities, wanted=wanted), "target_name")
    return joined.where(F.col("source_entity_id") != F.col("entity_id")).select("source_entity_id", F.col("entity_id").alias("target_entity_id"), "edge_type", *(carry or []))


@dataclass(frozen=True)
class Graph:
    """A graph with what it takes to keep it right as documents change: ``entities`` (id, name, display_name, ord, the scope),
    every ``raw`` edge by its target's name (source_entity_id, target_name, edge_type, the scope), resolved or not, and the
    resolved ``edges`` (source_entity_id, target_entity_id, edge_type, target_name, the scope)."""

    entities: DataFrame
    raw: DataFrame
    edges: DataFrame

    def dangling(self) -> DataFrame:
        """Raw edges whose target's name nobody has, or only their own source."""
        return self.raw.join(self.edges, ["source_entity_id", "target_name", "edge_type"], "left_anti")


def apply_delta(graph: Graph, entities: DataFrame, raw: DataFrame, *, scope: str = "document_id", touched: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Graph:
    """The graph after ``entities`` and ``raw`` edges replaced those of their scopes (of ``touched``, by default all that have
    new entities): the same, however a set of documents is cut into deltas.

    Names that an entity of the delta has or had may mean another one now. Edges to other names stay as they are; edges of the
    delta, and edges of untouched documents to these names, are resolved against all entities that carry them. So an edge is
    found that waited for its target, goes back to waiting when its target goes, and moves when the name passes to another.
    ``keep`` stores what is used more than once; with many deltas in one session it is needed, as each builds on the last.
    """
    scopes = (entities if touched is None else touched).select(scope).distinct()
    gone = graph.entities.join(scopes, scope, "left_semi")
    named = gone.select("name", "display_name").unionByName(entities.select("name", "display_name"))
    affected = keep(named.select(F.explode(F.array("name", "display_name")).alias("target_name")).where("target_name is not null").distinct())
    new_entities = keep(graph.entities.join(scopes, scope, "left_anti").unionByName(entities, allowMissingColumns=True))
    others = graph.raw.join(scopes, scope, "left_anti")
    columns = ["source_entity_id", "target_name", "edge_type", scope]
    todo = keep(raw.select(*columns).unionByName(others.select(*columns).join(affected, "target_name", "left_semi")))
    found = resolve_edges(todo, new_entities, carry=["target_name", scope], wanted=todo.select("target_name").distinct())
    same = graph.edges.join(scopes, scope, "left_anti").join(affected, "target_name", "left_anti")
    after = Graph(new_entities, keep(others.unionByName(raw.select(*columns), allowMissingColumns=True)), keep(same.unionByName(found.select(*same.columns))))
    free(affected, todo)
    return after


def replace_graph(old_entities: DataFrame, old_edges: DataFrame, entities: DataFrame, edges: DataFrame, *, scope: str = "document_id", touched: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and edges after new ones replaced those of the same ``scope`` (a document, or ``source_id``).

    Edges that touch a replaced entity go with it, as foreign keys cascade. ``touched`` lists the scopes (default: those that
    have new entities), so that one without any entity left loses its old ones.
    """
    touched = (entities if touched is None else touched).select(scope).distinct()
    gone = old_entities.join(touched, scope, "left_semi").select("id")
    kept_edges = old_edges.join(gone, old_edges["source_entity_id"] == gone["id"], "left_anti").join(gone, F.col("target_entity_id") == gone["id"], "left_anti")
    kept = old_entities.join(touched, scope, "left_anti")
    return kept.unionByName(entities, allowMissingColumns=True), kept_edges.unionByName(resolve_edges(edges, entities), allowMissingColumns=True)


def seeds(entities: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Entities whose name or display name contains ``term``; ``%`` and ``_`` in it are wildcards."""
    pattern = F.lower(F.lit(f"%{term}%"))
    return entities.where(F.like(F.lower("name"), pattern) | F.like(F.lower("display_name"), pattern)).orderBy("name", "id").limit(limit)


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) one hop away from ``ids`` (id) in either direction, without them: two equi-joins, not one with an or."""
    start = ids.select(F.col("id").alias("__id"))
    out = edges.join(start, F.col("source_entity_id") == F.col("__id")).select(F.col("target_entity_id").alias("id"))
    back = edges.join(start, F.col("target_entity_id") == F.col("__id")).select(F.col("source_entity_id").alias("id"))
    return out.unionByName(back).distinct().join(ids.select("id"), "id", "left_anti")


def hops(edges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, depth) of everything at most ``k`` undirected hops from ``ids``, with its least depth. ``k`` is small: each hop
    is a join in one plan."""
    both = edges.select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b")).unionByName(edges.select(F.col("target_entity_id").alias("a"), F.col("source_entity_id").alias("b"))).distinct()
    found = ids.select("id").distinct().withColumn("depth", F.lit(0))
    front = found
    for depth in range(1, k + 1):
        step = front.join(both, front["id"] == both["a"]).select(F.col("b").alias("id")).distinct()
        front = step.join(found, "id", "left_anti").withColumn("depth", F.lit(depth))
        found = found.unionByName(front)
    return found


def structural_candidates(entities: DataFrame, edges: DataFrame, term: str, seed_score: float = 1.0, neighbour_score: float = 0.7) -> DataFrame:
    """(chunk_id, score) of chunks of seed entities and their neighbours; a chunk of both has the seed's score."""
    start = seeds(entities, term).select("id", "chunk_id")
    near = neighbours(edges, start)
    around = entities.join(near, "id").select("chunk_id", F.lit(neighbour_score).alias("score"))
    return start.select("chunk_id", F.lit(seed_score).alias("score")).unionByName(around).where("chunk_id is not null").groupBy("chunk_id").agg(F.max("score").alias("score"))


def common_tokens(entities: DataFrame) -> dict[str, int]:
    """Tokens with more than a thousandth of all tokens of linkable names, by how often they occur: a thousand at most."""
    listed = _linkable(entities).where("fuzzy").select(F.explode("tokens").alias("token"))
    total = listed.count()
    return {r["token"]: r["df"] for r in listed.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") * 1000 > total).collect()}


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` with its columns as values: what follows, functions of array elements above all, doesn't compute them again."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _linkable(entities: DataFrame) -> DataFrame:
    kind, n = F.col("entity_type"), F.col("n")
    service = kind.isin(*KUBERNETES) & ((kind == "service") | F.lower(F.col("name")).contains("service"))
    named = _once(entities.select("id", "source_id", "entity_type", "name", normalize_name(F.col("name")).alias("n"), normalize_name(F.col("display_name")).alias("d")))
    return _once(named.select("id", "source_id", "entity_type", "n", "d", service.alias("service"), kind.isin(*TERRAFORM, *KUBERNETES, *DASHBOARDS).alias("fuzzy"), name_tokens(n).alias("tokens")))


def signatures(entities: DataFrame, common: Mapping[str, int]) -> DataFrame:
    """A row for each ``sig`` of an entity, with what deciding a link takes: of two entities that link, one ``sig`` at least is
    one of what the other ``meets``, and the other way round.

    Equal names share the hash of the name. For a score of THRESHOLD two names of ``mine`` and ``other`` tokens share ``need``
    of them at least, so that their first ``mine - need + 1`` and ``other - need + 1`` tokens, in one common order, have one in
    common: that token with ``mine`` and ``other`` and the entity's kind is a signature, which meets the token with ``other`` and
    ``mine`` of the kind that it may link with. ``common`` tokens come last in the order. Links don't depend on them,
    so those of an older state of the entities will do; the order has to be one for all rows that meet.
    """
    e, kind = _linkable(entities), F.col("entity_type")
    weights = F.create_map(*[F.lit(x) for k, v in common.items() for x in (k, v)]) if common else F.create_map().cast("map<string,bigint>")
    order = F.sort_array(F.transform("tokens", lambda t: F.struct(F.coalesce(F.try_element_at(weights, t), F.lit(0)).cast("long").alias("df"), t.alias("t"))))
    mine, ratio = F.col("mine"), THRESHOLD / (2 - THRESHOLD)
    sizes = F.sequence(F.greatest(F.lit(1), F.ceil(mine * ratio - 1e-9).cast("int")), F.greatest(F.lit(1), F.floor(mine / ratio + 1e-9).cast("int")))
    # Tokens count between two kinds of entities only: a kind's signature meets that of the kind it may link with.
    sides = F.array_compact(F.array(*[F.when(is_one, F.struct(F.lit(one).alias("own"), F.lit(two).alias("other"))) for is_one, one, two in (
        (kind.isin(*TERRAFORM), "tf", "k8s"), (kind.isin(*KUBERNETES), "k8s", "tf"), (F.col("service"), "service", "dashboard"), (kind.isin(*DASHBOARDS), "dashboard", "service"))]))
    signed = lambda x, other: F.transform("sides", lambda s: F.struct(F.xxhash64(x["t"], mine, other, s["own"]).alias("sig"), F.xxhash64(x["t"], other, mine, s["other"]).alias("meets")))
    prefix = lambda other: F.flatten(F.transform(F.slice("o", F.lit(1), F.greatest(F.lit(0), mine - F.ceil(THRESHOLD / 2 * (mine + other) - 1e-9).cast("int") + 1)), lambda x: signed(x, other)))
    whole = lambda h: F.struct(h.alias("sig"), h.alias("meets"))
    names = F.array_compact(F.array(F.when(F.col("n") != "", whole(F.xxhash64(F.lit("n"), "n"))), F.when(F.col("d") != "", whole(F.xxhash64(F.lit("d"), "d")))))
    tokens = F.when(F.col("fuzzy") & (mine > 0), F.flatten(F.transform(sizes, prefix))).otherwise(F.array().cast("array<struct<sig:bigint,meets:bigint>>"))
    each = _once(e.withColumn("o", order).withColumn("mine", F.size("tokens")).withColumn("sides", sides)).withColumn("s", F.explode(F.array_distinct(F.concat(names, tokens))))
    return each.select("id", "source_id", "entity_type", "n", "d", "service", "tokens", "s.sig", "s.meets")


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Links from ``left`` to entities of ``right`` with a greater source id, by their first strategy; once for each signature
    that brings a pair together.

    A signature first learns which other sources meet it: the join then follows the source too, so that what one source
    repeats is never compared with itself.
    """
    partners = right.select(F.col("meets").alias("sig"), F.col("source_id").alias("other")).distinct()
    # A small row may have many partners: spread over all partitions, whatever the rows' bytes are.
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asks = left.join(partners, "sig").where("source_id < other").repartition(n, "sig", "other")
    pair = asks.alias("x").join(right.repartition(n, "meets", "source_id").hint("merge").alias("y"), (F.col("x.sig") == F.col("y.meets")) & (F.col("x.other") == F.col("y.source_id")))
    kind = lambda side, kinds: F.col(f"{side}.entity_type").isin(*kinds)
    score = F.when(F.col("x.n") == F.col("y.n"), F.lit(1.0)).otherwise(dice(F.col("x.tokens"), F.col("y.tokens")))
    resource = (kind("x", TERRAFORM) & kind("y", KUBERNETES)) | (kind("x", KUBERNETES) & kind("y", TERRAFORM))
    service = (F.col("x.service") & kind("y", DASHBOARDS)) | (kind("x", DASHBOARDS) & F.col("y.service"))
    near = (F.size("x.tokens") > 0) & (F.size("y.tokens") > 0) & (F.col("score") >= THRESHOLD)
    strategy = F.when((F.col("x.n") == F.col("y.n")) & (F.col("x.n") != ""), "exact_name").when((F.col("x.d") == F.col("y.d")) & (F.col("x.d") != ""), "exact_display_name").when(resource & near, "resource_name").when(service & near, "service_name")
    found = pair.withColumn("score", score).withColumn("strategy", strategy).where("strategy is not null")
    score = F.when(F.col("strategy").startswith("exact"), F.lit(1.0)).otherwise(F.col("score"))
    return found.select(F.col("x.id").alias("source_entity_id"), F.col("y.id").alias("target_entity_id"), F.lit(CROSS_REF).alias("edge_type"), score.alias("score"), "strategy", F.col("y.source_id").alias("linked_source_id"))


def link_sources(entities: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New cross-source edges (source_entity_id, target_entity_id, edge_type, score, strategy, linked_source_id).

    Entities meet where they share a signature (see :func:`signatures`), so no pair is lost, and a word in every name brings
    none together that doesn't link. A pair is linked once, from the smaller source id, by its first strategy; pairs that
    ``existing`` edges link either way stay out. Names without a canonical form match nothing.
    """
    rows = signatures(entities, common_tokens(entities))
    links = _met(rows, rows).distinct()
    return links if existing is None else _unknown(links, existing)


def link_delta(index: DataFrame, new: DataFrame) -> DataFrame:
    """Links that entities with the signatures ``new`` have with those of ``index`` and with each other: what a full comparison
    would find besides the links within ``index``. Both sides' signatures are made with the same common tokens."""
    rows = index.select(*new.columns).unionByName(new)
    return _met(new, rows).unionByName(_met(index.select(*new.columns), new)).distinct()


def link_stored(index: BucketTable, gone: DataFrame, new: DataFrame) -> DataFrame:
    """:func:`link_delta` against signatures in buckets of ``meets`` (key: meets and id), which are brought up to date: those of
    ``gone`` (the signatures that replaced or removed entities had) go, ``new`` ones come. Only buckets of the delta are read
    and written. The links are stored before the index changes."""
    keys = gone.select(*index.key)
    left = index.near(new.select(F.col("sig").alias("meets"))).join(keys, list(index.key), "left_anti")
    links = written(link_delta(left, new))
    index.replace(keys, new)
    return links


def _unknown(links: DataFrame, existing: DataFrame) -> DataFrame:
    """Links of pairs that no cross-source edge of ``existing`` has, either way."""
    known = existing.where(F.col("edge_type") == CROSS_REF).select(F.least("source_entity_id", "target_entity_id").alias("x"), F.greatest("source_entity_id", "target_entity_id").alias("y"))
    return links.withColumn("x", F.least("source_entity_id", "target_entity_id")).withColumn("y", F.greatest("source_entity_id", "target_entity_id")).join(known, ["x", "y"], "left_anti").drop("x", "y")


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__rn = 1").drop("__rn")
