import re
from datetime import UTC, datetime, timedelta

import pytest

from lodestone.errors import ConfigError, Conflict, InvalidRequest
from lodestone.operators import embedding, filters, fulltext, fusion, graph, search, stats, vector, writer

NOW = datetime(2024, 1, 8, tzinfo=UTC)


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), "chunk_id string, score double")


def test_rrf(spark):
    a, b = hits(spark, ("x", 0.9), ("y", 0.5)), hits(spark, ("x", 7.0), ("z", 1.0))
    got = {r.chunk_id: r.score for r in fusion.reciprocal_rank_fusion([a, b]).collect()}
    assert got == pytest.approx({"x": 2 / 61, "y": 1 / 62, "z": 1 / 62})
    assert {r.score for r in fusion.reciprocal_rank_fusion([hits(spark, ("x", 1.0))], k=10).collect()} == {1 / 11}
    assert fusion.reciprocal_rank_fusion([spark.createDataFrame([], "chunk_id string, score double")]).count() == 0
    assert [r.score for r in fusion.noop_rerank(a).orderBy("chunk_id").collect()] == [1.0, 0.5]


def test_classifier_and_subject(spark):
    cases = {
        "what depends on AuthService": ("structural", "AuthService"), "references to MyClass": ("structural", "MyClass"), 'depends on "ERR_CONN_REFUSED"': ("structural", '"ERR_CONN_REFUSED"'),
        '"authenticate_token"': ("keyword", '"authenticate_token"'), "ERR_CONN_REFUSED": ("keyword", "ERR_CONN_REFUSED"), "why does HTTP_403 occur": ("keyword", "occur"),
        "how does authentication work": ("hybrid", "work"), "": ("hybrid", ""), "authenticate_token": ("hybrid", "authenticate_token"), "calls parse_token": ("structural", "parse_token"), "what uses Redis": ("structural", "Redis"),
    }
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(q,) for q in cases], "q string").select("q", search.classify(F.col("q")), search.subject(F.col("q"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases


def test_cover_density(spark):
    chunks = spark.createDataFrame([("a", "alpha x beta gamma alpha"), ("b", "beta alpha"), ("c", "alpha only"), ("d", "the alpha and the beta")], "chunk_id string, text string")
    index = fulltext.postings(chunks)
    two = {r.chunk_id: r.score for r in fulltext.search(index, "alpha beta", 9).collect()}
    assert two == pytest.approx({"a": 0.1 / 2 + 0.1 / 2, "b": 0.1, "d": 0.1 / 3})
    three = {r.chunk_id: r.score for r in fulltext.search(index, "alpha beta gamma", 9).collect()}
    assert three == pytest.approx({"a": 0.1 / 2 + 0.1})
    assert fulltext.search(index, "the and", 9).count() == 0
    stemmed = fulltext.postings(spark.createDataFrame([("a", "Running houses")], "chunk_id string, text string"), stem=True)
    assert fulltext.search(stemmed, "runs house", 5, stem=True).count() == 1


def test_vector_and_lsh(spark):
    rows = [(str(i), [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [("n", None), ("z", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    exact = [r.chunk_id for r in vector.nearest(df, [1.0, 0.0, 0.0], 5).collect()]
    assert len(exact) == 5
    near = [r.chunk_id for r in vector.LshIndex(df, tables=10, width=2.0).nearest([1.0, 0.0, 0.0], 5).collect()]
    assert len(set(near) & set(exact)) >= 4


def test_written_indexes(spark, sf, tmp_path):
    from lodestone.plans import corpus, queries

    chunks = corpus.chunks(spark, sf).select("id", "text", "embedding").persist()
    made = fulltext.postings(chunks, id="id")
    fulltext.write_index(made, str(tmp_path / "text"), buckets=8)
    written = fulltext.WrittenIndex(spark, str(tmp_path / "text"))
    for question in (queries.QUESTION, "inon tiea erre", "the", "nowhere inon"):
        want = [tuple(r) for r in fulltext.search(made, question, 30).collect()]
        assert [tuple(r) for r in fulltext.search(written, question, 30).collect()] == want
        assert [tuple(r) for r in fulltext.search(fulltext.Texts(chunks, id="id"), question, 30).collect()] == want
    plan = written.of(["inon"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "EqualTo(lexeme,inon)" in plan
    stemmed = fulltext.postings(chunks, id="id", stem=True)
    assert [tuple(r) for r in fulltext.search(stemmed, "inon tiea", 9, stem=True).collect()] == [tuple(r) for r in fulltext.search(fulltext.Texts(chunks, id="id"), "inon tiea", 9, stem=True).collect()]


@pytest.mark.parametrize("kind", ["cells", "projections"])
def test_recall_of_approximate_indexes(spark, tmp_path, kind):
    """The registered parameters against the exact search, for queries among the vectors and one of its own."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").persist()
    if kind == "cells":
        vector.write_cells(rows, str(tmp_path / "cells"), id="vec_id")
        index = vector.CellIndex(spark, str(tmp_path / "cells"))
        assert index.rows.count() == rows.where("embedding is not null").count()
    else:
        index = vector.LshIndex(rows, id="vec_id")
    asked = [list(r.embedding) for r in rows.where("vec_id % 97 = 0 and embedding is not null").limit(10).collect()] + [[1.0] + [0.0] * 63]
    hit = total = 0
    for q in asked:
        want = {r.chunk_id for r in vector.nearest(rows, q, 20, id="vec_id").collect()}
        hit += len(want & {r.chunk_id for r in index.nearest(q, 20).collect()})
        total += len(want)
    assert hit / total >= 0.9, hit / total


def test_a_word_in_every_name_brings_no_pairs_together(spark):
    def candidates(n):
        names = [(f"t{i}", "tf", "terraform_resource", f"prod_api_{i}a") for i in range(n)] + [(f"k{i}", "k8s", "k8s_resource", f"prod_web_{i}b") for i in range(n)]
        e = spark.createDataFrame([(*x, x[0]) for x in names], "id string, source_id string, entity_type string, name string, display_name string")
        assert graph.link_sources(e).count() == 0
        p = graph.signatures(e, graph.common_tokens(e)).persist()
        return p.alias("a").join(p.withColumn("sig", p.meets).alias("b"), "sig").where("a.source_id < b.source_id").count(), p.count()

    assert [c for c, _ in map(candidates, (30, 60))] == [0, 0] and candidates(60)[1] == 2 * candidates(30)[1]


def test_filters(spark):
    df = spark.createDataFrame([(1, NOW - timedelta(seconds=60), None, {"k": "v"}, '{"a": {"b": 1}, "t": [1, 2]}'), (2, NOW - timedelta(seconds=61), NOW, None, None)], "id int, indexed_at timestamp, tombstoned_at timestamp, metadata map<string,string>, raw string")
    ids = lambda *c: [r.id for r in filters.apply(df, *c).orderBy("id").collect()]
    assert ids() == [1, 2] and ids(filters.any_of("id", [])) == [1, 2] and ids(filters.any_of("id", [2])) == [2]
    assert ids(filters.fresh("indexed_at", 60, NOW)) == [1] and ids(filters.live()) == [1] and ids(filters.live(include_tombstoned=True)) == [1, 2]
    assert ids(filters.metadata_contains("metadata", {"k": "v"})) == [1] and ids(filters.metadata_contains("metadata", {"k": "w"})) == []
    assert ids(filters.metadata_contains("raw", {"a": {"b": 1}, "t": [2]}, nested=True)) == [1] and ids(filters.metadata_contains("raw", {"t": [3]}, nested=True)) == []
    deep = spark.createDataFrame([(1, '{"t": [{"b": 2, "a": [1, 3]}, 5]}'), (2, '{"t": {"a": 1}}')], "id int, raw string")
    found = lambda want: [r.id for r in deep.where(filters.metadata_contains("raw", want, nested=True)).collect()]
    assert found({"t": [{"a": [3]}]}) == [1] and found({"t": [{"a": [3], "b": 2}, 5]}) == [1] and found({"t": [{"a": [2]}]}) == [] and found({"t": []}) == [1]
    tenants = spark.createDataFrame([("a", "w1"), ("b", None), ("c", "w2")], "id string, workspace_id string")
    assert {r.id for r in filters.workspace(tenants, "w1").collect()} == {"a", "b"}
    assert filters.workspace(tenants, None).count() == 3
    scopes = spark.createDataFrame([(["admin"],), (["search"],)], "s array<string>")
    from pyspark.sql import functions as F

    assert [r[0] for r in scopes.select(filters.has_scopes(F.col("s"), ["search", "sources:write"])).collect()] == [True, False]


def test_tokens(spark):
    token, row = filters.issue_token("t", ["search"])
    schema = "id string, name string, prefix string, hash string, scopes array<string>, workspace_id string, expires_at timestamp, is_active boolean"
    tokens = spark.createDataFrame([tuple(row.values())], schema)
    asked = spark.createDataFrame([(token,), (token + "x",), (None,)], "token string")
    status = lambda t, *scopes: [r.status for r in filters.authenticate(asked, t, NOW, scopes).collect()]
    assert sorted(status(tokens, "search")) == ["ok", "unauthorized", "unauthorized"] and "forbidden" in status(tokens, "admin")
    assert set(status(filters.revoke_tokens(tokens, [row["id"]]))) == {"unauthorized"} and token not in row.values()


def test_request_bounds():
    with pytest.raises(InvalidRequest):
        search.SearchRequest("q", top_k=0)
    with pytest.raises(InvalidRequest):
        search.SearchRequest("q", max_age_seconds=0)


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, external_id string, text string")


def test_upsert(spark):
    empty = spark.createDataFrame([], "id string, source_id string, external_id string, content_hash string, doc_version long, indexed_at timestamp, tombstoned_at timestamp")
    one = writer.upsert_documents(empty, docs(spark, ("s", "a", "x"), ("s", "b", "y")), NOW)
    again = {r.external_id: (r.action, r.doc_version) for r in writer.actions(one, docs(spark, ("s", "a", "x \n\n"), ("s", "b", "z"), ("s", "c", "n"))).collect()}
    assert again == {"a": ("unchanged", 1), "b": ("updated", 2), "c": ("created", 1)}
    dead, found = writer.tombstone(one, spark.createDataFrame([("s", "a"), ("s", "zz")], "source_id string, external_id string"), NOW)
    assert {r.external_id: r.found for r in found.collect()} == {"a": True, "zz": False}
    back = writer.upsert_documents(dead, docs(spark, ("s", "a", "x")), NOW)
    assert back.where("tombstoned_at is null").count() == 2
    assert {r.action for r in writer.actions(dead, docs(spark, ("s", "a", "x")), revive=False).collect()} == {"unchanged"}
    chunks = spark.createDataFrame([(r.id, 0) for r in one.collect()], "document_id string, ord int")
    left, kept, gone = writer.purge(dead, chunks, 0, NOW)
    assert (left.count(), kept.count(), gone.first().purged) == (1, 1, 1)
    parents = spark.createDataFrame([("p",)], "id string")
    kids = spark.createDataFrame([("k1", "p"), ("k2", "q")], "id string, run string")
    assert {r.id: r.run for r in writer.set_null(kids, parents, "run").collect()} == {"k1": None, "k2": "q"}


def test_swap(spark, tmp_path):
    writer.swap(spark.range(3), f"{tmp_path}/t")
    seen = writer.version(spark, f"{tmp_path}/t")
    writer.swap(spark.range(5), f"{tmp_path}/t", after=seen)
    assert writer.current(spark, f"{tmp_path}/t").count() == 5
    with pytest.raises(Conflict):  # made from a version that isn't the latest any more
        writer.swap(spark.range(9), f"{tmp_path}/t", after=seen)
    real = writer.version
    writer.version = lambda *a: real(*a) - 1  # a writer that looked before the other one was done
    try:
        with pytest.raises(Conflict):
            writer.swap(spark.range(9), f"{tmp_path}/t")
    finally:
        writer.version = real
    (tmp_path / "t/_pointer" / f"n{2:019d}").touch()  # a writer that died
    assert writer.current(spark, f"{tmp_path}/t").count() == 5
    writer.swap(spark.range(7), f"{tmp_path}/t")
    assert writer.current(spark, f"{tmp_path}/t").count() == 7


def test_graph(spark):
    ents = spark.createDataFrame([("1", "d", "m.f", "f", 0), ("2", "d", "m.g", "f", 1), ("3", "e", "f", "zz", 2)], "id string, document_id string, name string, display_name string, ord int")
    names = {r.target_name: r.entity_id for r in graph.name_map(ents).collect()}
    assert names == {"m.f": "1", "m.g": "2", "f": "3", "zz": "3"}
    raw = spark.createDataFrame([("1", "m.g", "calls"), ("1", "m.f", "calls"), ("1", "nope", "calls")], "source_entity_id string, target_name string, edge_type string")
    solved = graph.resolve_edges(raw, ents)
    assert [tuple(r) for r in solved.collect()] == [("1", "2", "calls")]
    new_entities, new_edges = graph.replace_graph(ents, solved.withColumn("document_id", solved.edge_type), ents.where("id = '2'"), raw.limit(0))
    assert new_entities.count() == 2 and new_edges.count() == 0


def test_links(spark):
    rows = [
        ("t1", "tf", "terraform_resource", "aws_instance.web_app", "x1"), ("k1", "k8s", "k8s_resource", "Deployment/web-app", "x2"), ("s1", "k8s", "service", "checkout-service", "x3"),
        ("g1", "graf", "dashboard", "checkout overview", "x4"), ("e1", "aa", "thing", "My.Name", "x5"), ("e2", "bb", "thing", "my-name", "x6"), ("n1", "aa", "thing", "aws_", "x7"), ("n2", "bb", "thing", "tf_", "x8"),
    ]
    ents = spark.createDataFrame(rows, "id string, source_id string, entity_type string, name string, display_name string")
    links = {frozenset((r.source_entity_id, r.target_entity_id)): (r.strategy, round(r.score, 3)) for r in graph.link_sources(ents).collect()}
    assert links == {frozenset(("e1", "e2")): ("exact_name", 1.0), frozenset(("t1", "k1")): ("resource_name", 0.8), frozenset(("s1", "g1")): ("service_name", 0.667)}
    known = spark.createDataFrame([("e2", "e1", "cross_ref")], "source_entity_id string, target_entity_id string, edge_type string")
    assert graph.link_sources(ents, known).count() == 2


def test_stats(spark):
    checks = spark.createDataFrame([("db", "ok"), ("queue", "degraded")], "name string, status string")
    assert stats.health(checks).first().status == "degraded"
    rows = spark.createDataFrame([("fetch", 0.2), ("fetch", 40.0)], "stage string, s double")
    got = {r.le: r.n for r in stats.histogram(rows, "s", ["stage"]).collect()}
    assert (got["0.1"], got["0.25"], got["30.0"], got["+Inf"]) == (0, 1, 1, 2)
    runs = spark.createDataFrame([("r", "s", "a", "created", None, 1), ("r", "s", "b", "error", "one", 2), ("r", "s", "b", "error", "two", 3)], "run_id string, source_id string, external_id string, action string, error string, at int")
    r = stats.track_runs(runs).first()
    assert (r.docs_new, r.errors, r.status) == (1, {"b": "two"}, "partial")


def test_embedder_and_rerank(spark):
    calls = {"n": 0}
    made = embedding.embedder(embedding.provider("hash", dimension=16), 16)
    df = spark.createDataFrame([(str(i), f"word{i % 3} text") for i in range(70)], "chunk_id string, text string")
    from pyspark.sql import functions as F

    assert df.select(F.size(made(F.col("text")))).distinct().collect()[0][0] == 16
    query = embedding.hash_embedder(16)(["word1 text"])[0]
    top = fusion.rerank(df.withColumn("score", F.lit(1.0)), made, query, 3).collect()
    assert {r.text for r in top} == {"word1 text"} and calls == {"n": 0}
    with pytest.raises(Exception, match="unknown embedding provider"):
        embedding.provider("nope")
    assert list(embedding.batched([1, 2, 3], 2)) == [[1, 2], [3]]


def test_embedding_services():
    asked = []

    def post(url, body, headers):
        asked.append((url, body, headers))
        if "cohere" in url:
            return {"embeddings": {"float": [[1.0]] * len(body["texts"])}}
        return {"embeddings": [[1.0]] * len(body["input"])} if "11434" in url else {"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(body["input"])))]}

    assert embedding.provider("ollama", "nomic-embed-text", post=post)(["a", "b"]) == [[1.0], [1.0]]
    assert embedding.provider("openai", "m", api_key="k", post=post)(["a", "b"]) == [[0.0], [1.0]] == embedding.provider("voyage", "m", api_key="k", base_url="http://v/", post=post)(["a", "b"])
    assert embedding.provider("cohere", "m", api_key="k", post=post)(["a"]) == [[1.0]]
    assert asked[0][0] == "http://localhost:11434/api/embed" and asked[1][2] == {"Authorization": "Bearer k"} and asked[2][0] == "http://v/embeddings"
    with pytest.raises(Exception, match="api_key"):
        embedding.provider("openai", "m")
    with pytest.raises(ValueError):
        embedding.provider("ollama", "m", post=lambda *a: {"embeddings": []})(["a"])


def test_cover_density_of_any_number_of_lexemes(spark):
    import random

    def plain(hits, n):
        total, start, have = 0.0, 0, {}
        for end, (p, lexeme) in enumerate(hits):
            have[lexeme] = have.get(lexeme, 0) + 1
            if len(have) < n:
                continue
            while have[hits[start][1]] > 1:
                have[hits[start][1]] -= 1
                start += 1
            total += 0.1 / (1 + max(0, p - hits[start][0] - (end - start)))
            del have[hits[start][1]]
            start += 1
        return total

    rnd = random.Random(1)
    for n in (1, 2, 3, 5):
        rows = []
        for k in range(60):
            places = sorted(rnd.sample(range(1, 200), rnd.randrange(n, 40)))
            hits = [(p, "abcde"[rnd.randrange(n)]) for p in places]
            if len({x for _, x in hits}) == n:
                rows.append((k, hits))
        df = spark.createDataFrame(rows, "k int, hits array<struct<p:int,l:string>>")
        got = {r.k: r.s for r in df.select("k", fulltext.cover_density(df.hits, n).alias("s")).collect()}
        assert got == pytest.approx({k: plain(h, n) for k, h in rows})


def test_metadata_keys_with_quotes_and_arrays(spark):
    df = spark.createDataFrame([(1, '{"it\'s": {"a\\"b": [1, {"x": 2}, "y"]}}'), (2, '{"it\'s": 1}'), (3, "[1]"), (4, None), (5, "{")], "id int, m string")
    find = lambda want: sorted(r.id for r in df.where(filters.metadata_contains("m", want, nested=True)).collect())
    assert find({"it's": {'a"b': [{"x": 2}]}}) == find({"it's": {'a"b': ["y", 1]}}) == [1]
    assert find({"it's": 1}) == [2] and find({"it's": {'a"b': [2]}}) == find({"its": 1}) == []


def test_an_index_and_its_queries_agree_on_stems(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "running queries quickly"), ("b", "a run")], "id string, text string")
    made = fulltext.postings(chunks, id="id", stem=True)
    fulltext.write_index(made, str(tmp_path / "i"), stem=True)
    for index in (fulltext.Postings(made, True), fulltext.WrittenIndex(spark, str(tmp_path / "i"))):
        assert {r.chunk_id for r in fulltext.search(index, "runs", 5).collect()} == {"a", "b"}
        with pytest.raises(ConfigError):
            fulltext.search(index, "runs", 5, stem=False)
        assert search.Engine(sources=None, documents=None, chunks=chunks, embed=None, index=index).stem


def test_what_one_source_or_kind_repeats_is_not_compared_with_itself(spark):
    """A word and a name that all entities of a source have, and a word that kinds without links between them have in two
    sources: the links are those of brute force, and no join has more rows than a few for each entity."""
    from pyspark.sql import functions as F

    n = 300
    rows = [(f"t{i}", "a", "terraform_resource", f"aws_n{i}.x") for i in range(n)] + [(f"k{i}", "b", "k8s_resource", f"n{i}-zone7") for i in range(n)]
    rows += [(f"u{i}", "a", "terraform_resource", f"m{i}.zone7") for i in range(n)] + [(f"v{i}", "c", "k8s_resource", f"m{i} zone9") for i in range(n)]
    rows += [(f"w{i}", "d", "terraform_resource", f"o{i}_zone9") for i in range(2)] + [(f"s{i}", "e", "thing", "same") for i in range(n)]
    ents = spark.createDataFrame([(*r, r[0]) for r in rows], "id string, source_id string, entity_type string, name string, display_name string")
    links = {(r.source_entity_id, r.target_entity_id) for r in graph.link_sources(ents.where("id not like 'u%' and id not like 'w%'")).collect()}
    assert links == {(f"t{i}", f"k{i}") for i in range(n)}
    p = graph.signatures(ents, {})
    met = p.alias("a").join(p.alias("b"), F.col("a.sig") == F.col("b.meets")).where("a.source_id < b.source_id and a.entity_type = b.entity_type")
    assert met.count() == 0
    assert graph.link_sources(ents).count() == n + n * n + n + 2 * n  # t-k by name; u-k and w-v by zone; u-v by name
