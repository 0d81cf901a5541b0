"""The engine's registered queries and, for each that SQL can express, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import convert, entities as names, text
from lodestone.functions.vectors import cosine, literal
from lodestone.operators import filters, fulltext, fusion, graph, search, stats, vector, writer
from lodestone.plans import corpus
from lodestone.plans.corpus import NOW, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A fixed question of the registered searches: two frequent words, and a vector with one coordinate set.
QUESTION, UNIT = "inon tiea", [1.0] + [0.0] * 63
FILTERED = search.SearchRequest(QUESTION, top_k=20, types=["git", "fs"], max_age_seconds=604000, filters={"lang": "en"}, include_tombstoned=True)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- the logical tables in SQL -------------------------------------------------------------------------------------------

_N = "cast(coalesce(nullif(regexp_extract(name, '([0-9]+)$', 1), ''), '0') as int)"
SOURCES = f"""src as (select md5(name) as id, name, ['git', 'fs', 'confluence', 'slack'][n % 4 + 1] as type,
  case when n % 3 <> 0 then cast(n * 20000 as bigint) end as sla, case when n % 5 <> 0 then timestamp '2024-01-01' + to_hours(n * 10) end as last_sync_at,
  case when n % 2 = 1 then 'tenant' || (n % 3) end as tenant_id
  from (select name, {_N} as n from (select distinct source as name from documents where source is not null)))"""
DOCS = """doc as (select cast(doc_id as varchar) as id, md5(source) as source_id, 'doc://' || source || '/' || doc_id as uri, source || ' #' || doc_id as title,
  doc_id % 3 + 1 as doc_version, lang, timestamp '2024-01-01' + to_minutes(doc_id % 20000) as indexed_at,
  case when doc_id % 17 = 0 then timestamp '2024-01-01' + to_minutes(60 + doc_id % 20000) end as tombstoned_at, doc_id from documents)"""
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '')"
CHUNKS = f"""wrd as (select doc_id, lang, {WORDS} as ws from documents),
chk as (select doc_id || ':' || ord as id, doc_id, ord, lang, array_to_string(ws[ord * 384 + 1 : ord * 384 + 512], ' ') as text
  from (select doc_id, lang, ws, unnest(range(0, cast(1 + ceil(greatest(len(ws) - 512, 0) / 384) as bigint))) as ord from wrd where len(ws) > 0))"""
ENTITIES = """ent as (select 'region/' || r_regionkey as id, 'region' as source_id, 'region' as entity_type, r_name as name, null as chunk_id from region
  union all select 'nation/' || n_nationkey, 'nation', 'nation', n_name, null from nation
  union all select 'customer/' || c_custkey, 'customer', 'customer', c_name, c_custkey || ':0' from customer
  union all select 'supplier/' || s_suppkey, 'supplier', 'supplier', s_name, s_suppkey || ':0' from supplier),
edg as (select 'nation/' || n_nationkey as a, 'region/' || n_regionkey as b from nation
  union all select 'customer/' || c_custkey, 'nation/' || c_nationkey from customer
  union all select 'supplier/' || s_suppkey, 'nation/' || s_nationkey from supplier)"""
EVENTS = """evt as (select event_id, ts as at, cast(user_id as varchar) as external_id,
  case event_type when 'signup' then 'created' when 'error' then 'error' when 'purchase' then 'deleted' else 'updated' end as action,
  'run-' || strftime(ts, '%Y-%m-%d') as run_id, ['git', 'fs', 'confluence', 'slack'][user_id % 4 + 1] as source_type, value from events)"""
_STOP = ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS)
TOKENS = f"""tok as (select id, p, l from (select id, unnest(ts) as l, unnest(range(1, len(ts) + 1)) as p from (select id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as ts from chk)) where l not in ({_STOP}))"""
_A, _B = QUESTION.split()
MATCH = f"""hit as (select id, p, l, lag(l) over (partition by id order by p) as pl, lag(p) over (partition by id order by p) as pp from tok where l in ('{_A}', '{_B}')),
txt as (select id as chunk_id, coalesce(sum(case when l <> pl then 0.1::double / (p - pp) end), 0) as score from hit group by id having count(distinct l) = 2)"""
VEC = """vec as (select vec_id || ':0' as chunk_id, list_cosine_similarity(cast(embedding as double[]), list_concat([1.0::double], list_transform(range(63), lambda x: 0.0::double))) as score
  from embeddings join documents on vec_id = doc_id where embedding is not null and length(trim(text)) > 0)"""


def _top(name: str, n: int) -> str:
    return f"(select chunk_id, score from {name} order by score desc, chunk_id limit {n})"


RRF = f"""tv as {_top('vec', 40)}, tt as {_top('txt', 40)},
rrf as (select chunk_id, sum(1.0::double / (60 + r)) as score from (
  select chunk_id, row_number() over (order by score desc, chunk_id) as r from tv union all select chunk_id, row_number() over (order by score desc, chunk_id) as r from tt) group by chunk_id)"""


# --- text ----------------------------------------------------------------------------------------------------------------

_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '^\x{FEFF}+', ''), '(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])', chr(10), 'g'), '[\t \x1F\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+(\n|\z)', '\1', 'g'),
 '\n{3,}', chr(10) || chr(10), 'g'), '^\n+', chr(10)), '\n+\z', '')"""


@query(f"select doc_id, sha256({_NORMAL}) as content_hash from documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(f"select sha256({_NORMAL}) as content_hash, count(*) as n, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def exact_duplicates(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"with {CHUNKS} select doc_id, cast(ord as integer) as ord, sha256(text) as chunk_hash from chk")
def chunk_fixed_window(spark, sf_dir):
    c = text.fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return c.select("doc_id", "ord", F.sha2("chunk_text", 256).alias("chunk_hash"))


@query(f"with {CHUNKS} select source, count(*) as chunks, sum(len(string_split(c.text, ' '))) as words from chk c join documents d using (doc_id) group by source")
def chunk_stats_by_source(spark, sf_dir):
    c = text.fixed_windows(table(spark, sf_dir, "documents").select("source", "text"))
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size(F.split("chunk_text", " "))).alias("words"))


@query(f"select doc_id, len({WORDS}) as tokens, sha1(doc_id || ':' || source) as external_id from documents")
def token_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.token_count(F.col("text")).cast("long").alias("tokens"), text.fingerprint(F.col("doc_id"), F.col("source")).alias("external_id"))


def _markdown_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    out = "html"
    for pattern, to in convert.TAG_REWRITES:
        to = q(to).replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, {q(pattern)}, {to}, 'g')"
    for name, char in convert.ENTITIES:
        out = f"replace({out}, {q(name)}, {q(char)})"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"select page_id, sha256(regexp_replace({out}, '^[\s\x{{A0}}\x{{3000}}]+|[\s\x{{A0}}\x{{3000}}]+$', '', 'g')) as markdown_hash from pages"


@query(_markdown_sql())
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(convert.storage_to_markdown(F.col("html")), 256).alias("markdown_hash"))


@query("select conv_id, string_agg('**' || role || '**' || chr(10) || text, chr(10) || chr(10) order by turn) as document, count(*) as parts from conversations group by conv_id")
def thread_assembly(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("part", F.concat(F.lit("**"), "role", F.lit("**\n"), "text"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("parts"))
    return g.select("conv_id", F.array_join("parts.part", "\n\n").alias("document"), F.size("parts").cast("long").alias("parts"))


# --- search --------------------------------------------------------------------------------------------------------------


def _texts(spark, sf_dir) -> fulltext.Texts:
    return fulltext.Texts(corpus.chunk_texts(spark, sf_dir), id="id")


def _engine(spark, sf_dir) -> search.Engine:
    chunks = corpus.chunks(spark, sf_dir)
    return search.Engine(sources=corpus.sources(spark, sf_dir), documents=corpus.documents(spark, sf_dir), chunks=chunks, index=_texts(spark, sf_dir), embed=lambda q: UNIT, entities=corpus.entities(spark, sf_dir), edges=corpus.edges(spark, sf_dir), now=lambda: NOW, stem=False)


def _flat(hits: DataFrame) -> DataFrame:
    return hits.select("chunk_id", "document_id", F.round("score", 9).alias("score"), F.col("source.name").alias("source_name"), "citation.uri", "citation.title", "lineage.parser_version")


_FLAT = "c.id as chunk_id, cast(c.doc_id as varchar) as document_id, round(x.score, 9) as score, s.name as source_name, d.uri, d.title, 'v' || (c.doc_id % 2) as parser_version"
_ENRICH = "join chk c on c.id = x.chunk_id join doc d on d.doc_id = c.doc_id join src s on s.id = d.source_id"


@query(f"with {CHUNKS}, {DOCS}, {SOURCES}, {TOKENS}, {MATCH} select {_FLAT} from {_top('txt', 40)} x {_ENRICH} where d.tombstoned_at is null order by x.score desc, x.chunk_id limit 20")
def keyword_search(spark, sf_dir):
    return _flat(_engine(spark, sf_dir).search(search.SearchRequest(QUESTION, top_k=20, strategy="keyword")).hits)


@query(f"with {VEC} select chunk_id, round(score, 9) as score from {_top('vec', 20)}")
def vector_topk(spark, sf_dir):
    return vector.nearest(corpus.chunks(spark, sf_dir).withColumnRenamed("id", "chunk_id"), UNIT, 20).select("chunk_id", F.round("score", 9).alias("score"))


@query(f"with {CHUNKS}, {TOKENS}, {MATCH}, {VEC}, {RRF} select chunk_id, round(score, 9) as score from rrf")
def rrf_fusion(spark, sf_dir):
    lists = [vector.nearest(corpus.chunks(spark, sf_dir).withColumnRenamed("id", "chunk_id"), UNIT, 40), fulltext.search(_texts(spark, sf_dir), QUESTION, 40)]
    return fusion.reciprocal_rank_fusion(lists).select("chunk_id", F.round("score", 9).alias("score"))


@query(f"with {CHUNKS}, {DOCS}, {SOURCES}, {TOKENS}, {MATCH}, {VEC}, {RRF} select {_FLAT} from rrf x {_ENRICH} where d.tombstoned_at is null order by x.score desc, x.chunk_id limit 20")
def hybrid_search(spark, sf_dir):
    return _flat(_engine(spark, sf_dir).search(search.SearchRequest(QUESTION, top_k=20)).hits)


@query(f"with {CHUNKS}, {DOCS}, {SOURCES}, {TOKENS}, {MATCH}, {VEC}, {RRF} select {_FLAT} from rrf x {_ENRICH} where s.type in ('git', 'fs') and d.indexed_at >= timestamp '2024-01-08' - to_seconds(604000) and d.lang = 'en' order by x.score desc, x.chunk_id limit 20")
def hybrid_search_filtered(spark, sf_dir):
    return _flat(_engine(spark, sf_dir).search(FILTERED).hits)


@query(f"with {CHUNKS}, {TOKENS}, {MATCH}, {VEC}, tv as {_top('vec', 40)}, tt as {_top('txt', 40)} select (select count(*) from (select chunk_id from tv union select chunk_id from tt)) as total_matches_before_filters, (select count(*) from tv) as vector_matches, (select count(*) from tt) as text_matches")
def query_stats(spark, sf_dir):
    return _engine(spark, sf_dir).search(search.SearchRequest(QUESTION, top_k=20)).stats


_NEAR = "select b as id from edg join sd on a = sd.id union select a from edg join sd on b = sd.id"
_SEEDS = "sd as (select id, chunk_id from ent where lower(name) like '%supplier%0000_%' order by name, id limit 10)"


@query(f"with {ENTITIES}, {_SEEDS}, {CHUNKS}, {DOCS}, {SOURCES}, cand as (select chunk_id, max(score) as score from (select chunk_id, 1.0::double as score from sd union all select chunk_id, 0.7::double from ent where id in (select id from ({_NEAR}) where id not in (select id from sd))) where chunk_id is not null group by chunk_id) select {_FLAT} from cand x {_ENRICH} where d.tombstoned_at is null order by x.score desc, x.chunk_id limit 20")
def structural_search(spark, sf_dir):
    return _flat(_engine(spark, sf_dir).search(search.SearchRequest("who uses Supplier%0000_", top_k=20, strategy="auto")).hits)


_PHRASES = " or ".join(f"strpos(lower(q), '{p}') > 0" for p in search.STRUCTURAL_PHRASES)
_CASES = " ".join(f"when starts_with(lower(q), '{p}') then trim(substr(q, {len(p) + 1}))" for p in search.SUBJECT_PREFIXES)
_LOG = "lg as (select item_id, case item_id % 4 when 0 then 'what depends on ' || split_part(text, ' ', 1) when 1 then '\"' || split_part(text, ' ', 2) || '\"' when 2 then 'ERR_CONN ' || split_part(text, ' ', 1) else text end as q from benchmark)"


def _log(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    first, second = F.split_part(F.col("text"), F.lit(" "), F.lit(1)), F.split_part(F.col("text"), F.lit(" "), F.lit(2))
    k = F.col("item_id") % 4
    q = F.when(k == 0, F.concat(F.lit("what depends on "), first)).when(k == 1, F.concat(F.lit('"'), second, F.lit('"'))).when(k == 2, F.concat(F.lit("ERR_CONN "), first)).otherwise(F.col("text"))
    return b.select("item_id", q.alias("q"))


@query(f"with {_LOG} select item_id, case when {_PHRASES} then 'structural' when regexp_matches(q, '[\"''](.+?)[\"'']') or regexp_matches(q, '\\b[A-Z][A-Z0-9_]{{2,}}\\b') then 'keyword' else 'hybrid' end as strategy from lg")
def classify_queries(spark, sf_dir):
    return _log(spark, sf_dir).select("item_id", search.classify(F.col("q")).alias("strategy"))


@query(f"with {_LOG} select item_id, case {_CASES} else regexp_split_to_array(trim(q), '\\s+')[-1] end as subject from lg")
def extract_subject(spark, sf_dir):
    return _log(spark, sf_dir).select("item_id", search.subject(F.col("q")).alias("subject"))


# --- filters and joins ---------------------------------------------------------------------------------------------------


def _filter(name: str, where: str, *clauses):
    @query(f"with {DOCS}, {SOURCES} select d.id, s.name as source_name from doc d join src s on s.id = d.source_id where {where}")
    def run(spark, sf_dir):
        d, s = corpus.documents(spark, sf_dir), corpus.sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("type").alias("source_type"), "tenant_id")
        return filters.apply(d.join(s, "source_id"), *[c() for c in clauses]).select("id", "source_name")

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_filter("filter_source", "s.name in ('src1', 'src3')", lambda: filters.any_of("source_name", ["src1", "src3"]))
_filter("filter_source_type", "s.type = 'git'", lambda: filters.any_of("source_type", ["git"]))
_filter("filter_freshness", "d.indexed_at >= timestamp '2024-01-08' - to_seconds(600000)", lambda: filters.fresh("indexed_at", 600000, NOW))
_filter("filter_tombstone", "d.tombstoned_at is null", lambda: filters.live())
_filter("filter_metadata", "d.lang = 'fr'", lambda: filters.metadata_contains("metadata", {"lang": "fr"}))
_filter("filter_conjunction", "s.type = 'git' and d.tombstoned_at is null and d.lang = 'en'", lambda: filters.any_of("source_type", ["git"]), lambda: filters.live(), lambda: filters.metadata_contains("metadata", {"lang": "en"}))
_filter("filter_table_allow_deny", "s.name in ('src1', 'src2', 'src3') and s.name not in ('src2')", lambda: filters.allow_then_deny("source_name", ["src1", "src2", "src3"], ["src2"]))


@query("select event_id from events where json_extract_string(props, '$.k') = (select json_extract_string(props, '$.k') from events order by event_id limit 1)")
def filter_metadata_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    import json

    k = json.loads(e.orderBy("event_id").first()["props"])["k"]
    return e.where(filters.metadata_contains("props", {"k": k}, nested=True)).select("event_id")


@query(f"with {SOURCES} select name from src where tenant_id = 'tenant1' or tenant_id is null")
def filter_workspace(spark, sf_dir):
    return filters.workspace(corpus.sources(spark, sf_dir), "tenant1").select("name")


@query(f"with {CHUNKS}, {DOCS}, {SOURCES} select {_FLAT.replace('round(x.score, 9)', '1.0::double')} from (select id as chunk_id from chk) x {_ENRICH}")
def enrich_hits(spark, sf_dir):
    """Every chunk is a candidate."""
    chunks = corpus.chunks(spark, sf_dir)
    picked = chunks.select(F.col("id").alias("chunk_id"), F.lit(1.0).alias("score"))
    return _flat(search.enrich(picked, chunks, corpus.documents(spark, sf_dir), corpus.sources(spark, sf_dir), bounded=False).select(*search.hit_columns()))


@query(f"with {CHUNKS} select id, 'v' || (doc_id % 2) as parser_version, 'run' || (doc_id % 5) as ingestion_run_id from chk where doc_id % 2 = 1 and doc_id % 5 = 2")
def lineage_by_parser(spark, sf_dir):
    return _engine(spark, sf_dir).lineage(parser_version="v1", ingestion_run_id="run2").select("id", "parser_version", "ingestion_run_id")


@query(f"with {DOCS}, {CHUNKS} select c.id, cast(c.ord as integer) as ord, c.text from chk c where c.doc_id = (select min(doc_id) from documents) order by ord")
def get_document(spark, sf_dir):
    first = table(spark, sf_dir, "documents").agg(F.min("doc_id")).first()[0]
    return _engine(spark, sf_dir).get_document(str(first))[1].select("id", "ord", "text")


# --- statistics ----------------------------------------------------------------------------------------------------------


@query(f"""with {SOURCES}, {DOCS}, cnt as (select source_id, count(*) as n from doc where tombstoned_at is null group by source_id)
select s.id, name, type, coalesce(n, 0) as document_count, case when sla is null then false when last_sync_at is null then true else date_diff('second', last_sync_at, timestamp '2024-01-08') > sla end as is_stale
from src s left join cnt on cnt.source_id = s.id""")
def list_sources_freshness(spark, sf_dir):
    return stats.list_sources(corpus.sources(spark, sf_dir), corpus.documents(spark, sf_dir), NOW)


@query(f"with {DOCS} select source_id, count(*) as total_documents, count(*) filter (where tombstoned_at is null) as active_documents from doc group by source_id")
def source_document_counts(spark, sf_dir):
    return stats.document_counts(corpus.documents(spark, sf_dir))


@query(f"with {DOCS}, {CHUNKS} select source_id, count(*) as total_chunks, count(*) filter (where tombstoned_at is null) as active_chunks from chk c join doc d using (doc_id) group by source_id")
def source_chunk_counts(spark, sf_dir):
    return stats.chunk_counts(corpus.chunks(spark, sf_dir), corpus.documents(spark, sf_dir))


_RUNS = """run as (select run_id || '/' || source_type as id, source_type as source_id, min(evt.at) as started_at, max(evt.at) as finished_at,
  case when count(*) filter (where action = 'error') > 0 then 'partial' else 'ok' end as status from evt group by run_id, source_type)"""


@query(f"with {EVENTS}, {_RUNS} select source_id, arg_max(id, (started_at, id)) as id, arg_max(status, (started_at, id)) as status from run group by source_id")
def latest_run_per_source(spark, sf_dir):
    return stats.latest_run(corpus.runs(spark, sf_dir)).select("source_id", "id", "status")


@query(f"with {EVENTS}, {_RUNS} select id, status from run where source_id = 'git' order by started_at desc, id limit 20")
def list_runs(spark, sf_dir):
    return stats.list_runs(corpus.runs(spark, sf_dir), source_id="git", limit=20).select("id", "status")


@query(f"""with {EVENTS}, er as (select run_id, source_type, count(distinct external_id) as failed from evt where action = 'error' group by all)
select e.run_id, e.source_type as source_id, count(*) filter (where action = 'created') as docs_new, count(*) filter (where action = 'updated') as docs_updated, count(*) filter (where action = 'deleted') as docs_removed,
coalesce(any_value(failed), 0) as failed, case when any_value(failed) is null then 'ok' else 'partial' end as status from (select *, run_id || '/' || source_type as r from evt) e left join er on er.run_id = e.run_id and er.source_type = e.source_type group by e.run_id, e.source_type""")
def run_counters(spark, sf_dir):
    e = corpus.change_events(spark, sf_dir).withColumn("error", F.when(F.col("action") == "error", F.col("value").cast("string")))
    r = stats.track_runs(e.withColumn("source_id", F.col("source_type")).withColumn("run_id", F.concat("run_id", F.lit("/"), "source_type")))
    return r.select(F.split_part("run_id", F.lit("/"), F.lit(1)).alias("run_id"), "source_id", "docs_new", "docs_updated", "docs_removed", F.col("docs_failed").alias("failed"), "status")


_LE = " union all ".join(f"select source_type, '{b}' as le, count(*) filter (where value <= {b}) as n from evt group by source_type" for b in stats.STAGE_BUCKETS)


@query(f"with {EVENTS} {_LE} union all select source_type, '+Inf', count(value) from evt group by source_type")
def stage_histogram(spark, sf_dir):
    return stats.histogram(corpus.change_events(spark, sf_dir), "value", ["source_type"])


# --- writing -------------------------------------------------------------------------------------------------------------

_NEW = "case when doc_id % 7 = 0 then text || ' changed' else text end"


def _incoming(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents with an even id are stored; all come in, every seventh with another text."""
    d = table(spark, sf_dir, "documents")
    stored = corpus.documents(spark, sf_dir, hashed=True).where("cast(id as bigint) % 2 = 0")
    new = d.select(F.md5("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))
    return stored, new


@query(f"""select cast(doc_id as varchar) as external_id, case when doc_id % 2 = 1 then 'created' when doc_id % 7 = 0 or doc_id % 17 = 0 then 'updated' else 'unchanged' end as action,
case when doc_id % 2 = 1 then 1 when doc_id % 7 = 0 or doc_id % 17 = 0 then doc_id % 3 + 2 else doc_id % 3 + 1 end as doc_version from documents""")
def upsert_actions(spark, sf_dir):
    return writer.actions(*_incoming(spark, sf_dir)).select("external_id", "action", "doc_version")


@query(f"""with {DOCS} select cast(doc_id as varchar) as external_id, case when doc_id % 2 = 1 then 1 when doc_id % 7 = 0 or doc_id % 17 = 0 then doc_id % 3 + 2 else doc_id % 3 + 1 end as doc_version,
case when doc_id % 2 = 1 or doc_id % 7 = 0 or doc_id % 17 = 0 then timestamp '2024-01-08' else indexed_at end as indexed_at from doc""")
def upsert_state(spark, sf_dir):
    return writer.upsert_documents(*_incoming(spark, sf_dir), NOW).select("external_id", "doc_version", F.col("indexed_at").cast("timestamp_ntz").alias("indexed_at"))


@query(f"with {DOCS} select count(*) as purged from doc where tombstoned_at is not null and tombstoned_at <= timestamp '2024-01-08' - to_seconds(594000)")
def tombstone_purge(spark, sf_dir):
    return writer.purge(corpus.documents(spark, sf_dir), corpus.chunks(spark, sf_dir).withColumnRenamed("id", "cid"), 594000, NOW)[2]


@query(f"with {DOCS} select id, case when doc_id % 10 = 0 then timestamp '2024-01-08' else tombstoned_at end as tombstoned_at from doc")
def tombstone_mark(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    out = writer.tombstone(d, d.where("cast(id as bigint) % 10 = 0"), NOW)[0]
    return out.select("id", F.col("tombstoned_at").cast("timestamp_ntz").alias("tombstoned_at"))


@query(f"with {CHUNKS} select c.id from chk c where doc_id % 17 <> 0")
def cascade_delete(spark, sf_dir):
    gone = corpus.documents(spark, sf_dir).where("tombstoned_at is not null")
    return writer.cascade(corpus.chunks(spark, sf_dir), gone, "document_id").select("id")


# --- graph ---------------------------------------------------------------------------------------------------------------


@query(f"with {ENTITIES}, {_SEEDS}, near as ({_NEAR}) select id from near where id not in (select id from sd)")
def graph_one_hop(spark, sf_dir):
    return graph.neighbours(corpus.edges(spark, sf_dir), graph.seeds(corpus.entities(spark, sf_dir), "Supplier%0000_").select("id"))


@query(f"""with recursive {ENTITIES}, bth as (select a, b from edg union select b, a from edg), walk(id, depth) as (select 'region/0', 0 union select b, depth + 1 from walk join bth on a = id where depth < 2)
select id, min(depth) as depth from walk group by id""")
def graph_k_hop(spark, sf_dir):
    return graph.hops(corpus.edges(spark, sf_dir), spark.createDataFrame([("region/0",)], "id string"), 2)


_NN = r"regexp_replace(regexp_replace(regexp_replace(lower({c}), '^(aws_|azurerm_|azure_|google_|gcp_|gke_|k8s_|tf_|var_|data_)+', ''), '[-./: ]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"select p_partkey, {_NN.format(c=chr(39) + 'aws_k8s_' + chr(39) + ' || p_name')} as normal from part")
def normalize_entity_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.normalize_name(F.concat(F.lit("aws_k8s_"), "p_name")).alias("normal"))


_TK = "list_distinct(list_filter(string_split({c}, '_'), lambda t: len(t) > 1 and t not in ('deployment', 'service', 'configmap', 'secret', 'pod', 'replicaset', 'statefulset')))"


@query(f"""with e as (select 'tf/' || s_suppkey as id, 'a' as src, {_NN.format(c="'aws_' || s_name || '.x' || (s_suppkey % 50)")} as n from supplier
union all select 'k8s/' || s_suppkey, 'b', {_NN.format(c="'Deployment/' || s_name || '-y' || (s_suppkey % 20)")} from supplier),
t as (select *, {_TK.format(c='n')} as tk from e)
select a.id as source_entity_id, b.id as target_entity_id, round(case when a.n = b.n then 1.0::double else 2.0::double * len(list_intersect(a.tk, b.tk)) / (len(a.tk) + len(b.tk)) end, 9) as score,
case when a.n = b.n then 'exact_name' else 'resource_name' end as strategy
from t a join t b on a.src = 'a' and b.src = 'b' and (a.n = b.n or (len(a.tk) + len(b.tk) > 0 and 2.0::double * len(list_intersect(a.tk, b.tk)) / (len(a.tk) + len(b.tk)) >= 0.5))""")
def dice_links(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    tf = s.select(F.concat(F.lit("tf/"), "s_suppkey").alias("id"), F.lit("a").alias("source_id"), F.lit("terraform_resource").alias("entity_type"), F.concat(F.lit("aws_"), "s_name", F.lit(".x"), F.col("s_suppkey") % 50).alias("name"), F.concat(F.lit("t"), "s_suppkey").alias("display_name"))
    k8s = s.select(F.concat(F.lit("k8s/"), "s_suppkey").alias("id"), F.lit("b").alias("source_id"), F.lit("k8s_resource").alias("entity_type"), F.concat(F.lit("Deployment/"), "s_name", F.lit("-y"), F.col("s_suppkey") % 20).alias("name"), F.concat(F.lit("k"), "s_suppkey").alias("display_name"))
    return graph.link_sources(tf.unionByName(k8s)).select("source_entity_id", "target_entity_id", F.round("score", 9).alias("score"), "strategy")


# --- streams, in batch form ----------------------------------------------------------------------------------------------


@query(f"""with {EVENTS}, g as (select external_id, date_diff('microsecond', lag(evt.at) over (partition by external_id order by evt.at), evt.at) as gap from evt)
select external_id, count(*) as deliveries, count(*) filter (where gap <= 86400000000) as duplicates from g group by external_id""")
def replay_dedup(spark, sf_dir):
    from lodestone.streaming import changes

    e = changes.mark_replays(corpus.change_events(spark, sf_dir), id="external_id", seconds=86400)
    return e.groupBy("external_id").agg(F.count(F.lit(1)).alias("deliveries"), F.count_if("duplicate").alias("duplicates"))


@query(f"with {EVENTS} select event_id from evt where event_id % 600 <= 300")
def late_event_filter(spark, sf_dir):
    from lodestone.streaming import changes

    e = corpus.change_events(spark, sf_dir).withColumn("sent", F.unix_timestamp("at").cast("double"))
    return e.where(~changes.is_late(F.col("sent"), F.col("sent") + F.col("event_id") % 600)).select("event_id")


@query("""with recursive e as (select cast(user_id as varchar) as key, epoch_us(ts) / 1000000.0::double as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
b as (select key, n, t, 0.0::double as tokens, true as allowed from e where n = 1 union all
  select key, n, t, x - case when x >= 1 then 1 else 0 end, x >= 1 from (select e.*, least(1.0::double, b.tokens + (e.t - b.t) / 60) as x from b join e on e.key = b.key and e.n = b.n + 1))
select key, count(*) filter (where allowed) as allowed, count(*) filter (where not allowed) as rejected from b group by key""")
def token_bucket(spark, sf_dir):
    from lodestone.streaming import changes

    e = corpus.change_events(spark, sf_dir).select(F.col("external_id").alias("key"), "at", "event_id")
    return changes.token_bucket(e, rpm=1).groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("rejected"))


@query("select event_type as action, count(*) as n from events where event_type in ('click', 'view') group by event_type")
def dead_letter_split(spark, sf_dir):
    from lodestone.streaming import changes

    e = table(spark, sf_dir, "events").withColumn("attempt", F.when(F.col("event_type").isin("click", "view"), 4).otherwise(5))
    return changes.split_dead_letters(e)[0].groupBy(F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"))


# --- what SQL can't express: checked in the tests ------------------------------------------------------------------------


@query()
def keyword_search_stemmed(spark, sf_dir):
    return fulltext.search(_texts(spark, sf_dir), "inon tiea erre", 20, stem=True)


@query()
def rerank(spark, sf_dir):
    from lodestone.operators import embedding

    hits = _engine(spark, sf_dir).search(search.SearchRequest(QUESTION, top_k=50)).hits
    made = embedding.embedder(embedding.provider("hash", dimension=64), 64)
    return fusion.rerank(hits, made, embedding.hash_embedder(64)([QUESTION])[0], 10).select("chunk_id", "score")


@query()
def vector_lsh(spark, sf_dir):
    return vector.LshIndex(corpus.chunks(spark, sf_dir), id="id").nearest(UNIT, 20)


@query()
def parse_pages(spark, sf_dir):
    from lodestone import parsers

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.concat("page_id", F.lit(".md")).alias("path"), F.lit("text/markdown").alias("content_type"), F.encode(convert.storage_to_markdown(F.col("html")), "UTF-8").alias("content"))
    return parsers.parse_documents(pages).select("id", "title", F.size("sections").alias("sections"))


@query()
def schema_markdown(spark, sf_dir):
    """The test tables' own schemas as documents."""
    from lodestone.sources import database

    names_ = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    rows = [("main", t, f.name, i, f.dataType.simpleString(), f.dataType.simpleString(), "YES", None, None, None, None, None) for t in names_ for i, f in enumerate(table(spark, sf_dir, t).schema.fields, 1)]
    columns = spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, udt_name string, is_nullable string, column_default string, character_maximum_length int, numeric_precision int, numeric_scale int, comment string")
    keys = spark.createDataFrame([("main", "nation", "PRIMARY KEY", "pk", "n_nationkey", None, None, None, 1), ("main", "nation", "FOREIGN KEY", "fk", "n_regionkey", "region", "r_regionkey", None, 1)], "table_schema string, table_name string, constraint_type string, constraint_name string, column_name string, foreign_table_name string, foreign_column_name string, check_clause string, ordinal int")
    return database.schema_markdown(columns.select("table_schema", "table_name").distinct(), columns, keys)


from lodestone.plans import derived  # noqa: E402, F401  (registers its queries)
