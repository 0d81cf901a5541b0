"""Ingestion: ids for life, and a state that doesn't depend on how documents are cut into batches."""

import time
from datetime import UTC, datetime

from pyspark.sql import functions as F

from lodestone.operators import fulltext, graph, ingest, search
from lodestone.session import free, shared_folder, written

T0 = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "source_id string, external_id string, path string, content_type string, content binary"
FILES = {
    ("git", "lib.py"): "def shared():\n    return 1\n\nclass Base:\n    pass\n",
    ("git", "app.py"): "import lib\n\ndef main():\n    return shared()\n\nclass Child(Base):\n    pass\n",
    ("git", "other.py"): "def more():\n    return main()\n",
    ("tf", "net.tf"): 'resource "aws_service" "payments_api" {\n}\n',
    ("k8s", "d.yaml"): "kind: Service\nmetadata:\n  name: payments-api\nspec: {}\n",
}


def run(spark, tables, files, seq):
    rows = [(s, e, e, "", text.encode()) for (s, e), text in files.items()]
    content = spark.createDataFrame(rows, SCHEMA)
    events = spark.createDataFrame([(s, e, "updated", seq) for s, e in files], "source_id string, external_id string, action string, seq long")
    return ingest.ingest(tables, events, lambda keys: content.join(keys, ["source_id", "external_id"], "left_semi"), T0, run_id=f"r{seq}", keep=written).tables


def state(t):
    names = {r.id: r.name for r in t.entities.collect()}
    edges = sorted((names[r.source_entity_id], r.edge_type, names[r.target_entity_id]) for r in t.edges.collect())
    links = sorted((names[r.source_entity_id], names[r.target_entity_id], r.strategy, r.score) for r in t.links.collect())
    chunks = sorted((r.id, r.document_id, r.text) for r in t.chunks.collect())
    return edges, links, chunks, sorted((r.chunk_id, r.lexeme) for r in t.postings.collect()), sorted(r.id for r in t.documents.collect())


def test_batches_do_not_matter(spark):
    keys = list(FILES)
    at_once = state(run(spark, ingest.empty(spark), FILES, 1))
    tables = ingest.empty(spark)
    for seq, batch in enumerate(([2, 4], [1], [0, 3]), 1):  # targets come after what names them
        tables = run(spark, tables, {keys[k]: FILES[keys[k]] for k in batch}, seq)
    assert state(tables) == at_once
    edges, links = at_once[:2]
    assert ("app.main", "calls", "lib.shared") in edges and ("app.Child", "inherits", "lib.Base") in edges and ("other.more", "calls", "app.main") in edges
    assert links == [("Service/default/payments-api", "resource.aws_service.payments_api", "exact_display_name", 1.0)]
    # A target that goes leaves its edges waiting; they come back with it.
    without = run(spark, tables, {("git", "lib.py"): "def else_():\n    return 1\n"}, 9)
    assert not [e for e in state(without)[0] if e[2] == "lib.shared"] and ("other.more", "calls", "app.main") in state(without)[0]
    assert without.graph().dangling().where("target_name = 'shared'").count() == 1
    assert state(run(spark, without, {("git", "lib.py"): FILES["git", "lib.py"]}, 10))[:2] == at_once[:2]


def test_a_document_keeps_its_id(spark):
    tables = run(spark, ingest.empty(spark), {("s", "a.txt"): "first words"}, 1)
    renamed = tables.documents.selectExpr("'d1' as id", *[c for c in tables.documents.columns if c != "id"])
    old = tables.chunks.selectExpr("'d1:0' as id", "'d1' as document_id", *[c for c in tables.chunks.columns if c not in ("id", "document_id")])
    from dataclasses import replace

    after = run(spark, replace(tables, documents=renamed, chunks=old, postings=tables.postings.selectExpr("'d1:0' as chunk_id", "lexeme", "positions")), {("s", "a.txt"): "running queries quickly"}, 2)
    assert [(r.id, r.doc_version) for r in after.documents.collect()] == [("d1", 2)]
    assert [(r.id, r.document_id) for r in after.chunks.collect()] == [("d1:0", "d1")] and {r.chunk_id for r in after.postings.collect()} == {"d1:0"}
    # What was ingested is found by the default engine, by any form of a word.
    sources = spark.createDataFrame([("s", "s", "fs")], "id string, name string, type string")
    documents = after.documents.selectExpr("*", "'u' as uri", "'t' as title", "map('k', 'v') as metadata")
    chunks = after.chunks.selectExpr("*", "cast(null as string) as embedding_model", "cast(null as string) as embedding_provider", "cast(null as string) as parser_version")
    engine = search.Engine(sources=sources, documents=documents, chunks=chunks, embed=lambda q: [1.0], index=after.index())
    found = engine.search(search.SearchRequest("runs query", strategy="keyword")).hits.collect()
    assert [(r.chunk_id, r.document_id) for r in found] == [("d1:0", "d1")]


def test_a_name_passes_to_another_entity(spark):
    ents = lambda *rows: spark.createDataFrame(list(rows), "id string, document_id string, name string, display_name string, ord string")
    raw = lambda *rows: spark.createDataFrame(list(rows), "source_entity_id string, target_name string, edge_type string, document_id string")
    empty = graph.Graph(ents(), raw(), spark.createDataFrame([], "source_entity_id string, target_entity_id string, edge_type string, target_name string, document_id string"))
    targets = lambda g: sorted((r.source_entity_id, r.target_entity_id) for r in g.edges.collect())
    delta = lambda *a, **b: graph.apply_delta(*a, **b, keep=written)
    one = delta(empty, ents(("x", "dx", "x", "x", "1")), raw(("x", "f", "calls", "dx"), ("x", "f", "calls", "dx"), ("x", "x", "calls", "dx"), ("x", None, "calls", "dx")))
    assert targets(one) == [] and one.dangling().count() == 4
    two = delta(one, ents(("b", "db", "m.f", "f", "2")), raw())
    assert targets(two) == [("x", "b")] * 2
    three = delta(two, ents(("a", "da", "k.f", "f", "1")), raw())  # the first of a display name
    assert targets(three) == [("x", "a")] * 2
    four = delta(three, ents(("c", "dc", "f", "f", "9")), raw())  # a full name goes first
    assert targets(four) == [("x", "c")] * 2
    gone = spark.createDataFrame([("dc",), ("da",)], "document_id string")
    assert targets(delta(four, ents(), raw(), touched=gone)) == [("x", "b")] * 2


def test_the_registered_state_is_kept(spark, sf):
    """What a batch uses more than once is stored: nothing of the state is made from the documents again when it is read."""
    from lodestone.plans.queries import QUERIES

    plan = QUERIES["ingest_state"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "written-" in plan and "documents.parquet" not in plan


def test_what_is_stored_on_the_way_goes(spark):
    """Of a batch only the state and its results stay on disk, and of a spent state nothing."""
    import glob
    import os
    import random

    held, rnd = [], random.Random(1)
    folders = lambda: set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/written-*"))
    size = lambda paths: sum(os.path.getsize(f) for p in paths for f in glob.glob(f"{p}/*.parquet"))
    before = folders()

    def keep(df):
        out = written(df)
        held.append(size(folders() - before))
        return out

    text = lambda: " ".join(f"{rnd.getrandbits(48):x}" for _ in range(400))
    content = spark.createDataFrame([("s", f"d{k}", f"d{k}.txt", "", text().encode()) for k in range(60)], SCHEMA).repartition(2)
    one = size(written(content)._stored_at)
    before = folders()
    events = lambda seq: content.selectExpr("source_id", "external_id", "'updated' as action", f"cast({seq} as long) as seq")
    step = lambda t, seq, more, **how: ingest.ingest(t, events(seq), lambda keys: content.withColumn("content", F.concat("content", F.encode(F.lit(more), "UTF-8"))).join(keys, ["source_id", "external_id"], "left_semi"), T0, run_id=f"r{seq}", keep=keep, **how)
    first = step(ingest.empty(spark), 1, "")
    stored = [spark.read.parquet(p).columns for p in folders() - before]
    assert not [c for c in stored if "content" in c or "sections" in c]
    kept = step(first.tables, 2, " lion")
    assert first.tables.chunks.count() == 60 and first.tables.postings.where("lexeme = 'lion'").count() == 0
    # At most two states (texts and postings), and once more the contents and what is parsed from them.
    assert max(held) < 6 * one
    free(first.results, kept.results, *vars(first.tables).values())
    held.clear()
    second = step(kept.tables, 3, " zebra", spend=True)
    assert max(held) < 4 * one, [round(h / one, 2) for h in held]
    left = folders() - before
    assert {p.removeprefix("file:") for t in (second.results, *vars(second.tables).values()) for p in getattr(t, "_stored_at", ())} == left
    assert second.tables.chunks.count() == 60 and second.tables.postings.where("lexeme = 'zebra'").count() == 60
    assert second.tables.documents.where("doc_version = 3").count() == 60


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_") and f.endswith(".data")}

    before = shuffled()
    out, until = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()), time.monotonic() + 10
    while shuffled() - before and time.monotonic() < until:  # executors delete them in their own time
        time.sleep(0.1)
    assert not shuffled() - before
    assert out.count() == 7


def test_postings_without_chunks(spark):
    rows = [(f"d{c // 3}:{c % 3}", x, [p, p + 2] if p % 2 else [p]) for c in range(40) for p, x in enumerate(("ab", "é", "x"[: c % 2] or "y"), 1)]
    rows += [("odd", None, [1]), ("odd", "two words", []), ("odd", "n", None)]
    postings = spark.createDataFrame(rows, "chunk_id string, lexeme string, positions array<int>").repartition(3)
    gone = spark.createDataFrame([("d1:0",), ("d1:2",), ("d9:9",)], "chunk_id string")
    got = fulltext.without_chunks(postings, gone)
    key = lambda r: (r[0], str(r[1]), str(r[2]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((r for r in rows if r[0] not in ("d1:0", "d1:2")), key=key)
    assert got.columns == ["chunk_id", "lexeme", "positions"]
