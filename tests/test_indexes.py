"""Postings by impact, substrings by trigrams and JSON by paths: each equals the scan that it replaces."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.errors import ConfigError, Conflict, InvalidRequest
from lodestone.operators import filters, fulltext, graph, impact, terms

QUERIES = ["red", "red blue", "blue red green", "red blue green gold", "rare red", "rare", "absent", "red absent", "the", ""]


def _texts(seed: int, n: int) -> list[tuple[str, str | None]]:
    """Dense and sparse texts, some longer than one round of zones, with ties, a repeated one and a null."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = r.choices(["red", "blue", "green", "gold", "filler", "more"], [8, 4, 2, 1, r.choice([1, 60]), 5], k=r.choice([3, 8, 40, 400, 1500]))
        out.append((f"c{i:03}", " ".join(words + ["rare"] * (i % 29 == 0))))
    return [*out, ("tie1", out[0][1]), ("tie2", out[0][1]), ("none", None), ("empty", "")]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string")


def _same(index, postings, limits=(5,), queries=("red", "red blue", "blue red green", "rare red")):
    for q in queries:
        for limit in limits:
            want = [(r[0], r[1]) for r in fulltext.search(fulltext.Postings(postings), q, limit).collect()]
            assert [(r[0], r[1]) for r in index.top(q, limit).collect()] == want, (q, limit)


@pytest.fixture(scope="module")
def chunks(spark):
    return _frame(spark, _texts(1, 80)).cache()


def test_impact_equals_scan(spark, tmp_path, chunks):
    rows = fulltext.postings(chunks).cache()
    index = impact.ImpactIndex(spark, str(tmp_path / "i"), buckets=2)
    assert index.top("red", 3).count() == 0  # nothing is committed yet
    index.add(rows)
    _same(index, rows, queries=QUERIES)
    _same(index, rows, limits=(1, 500), queries=["red blue"])
    found = index.find("red", 3)
    assert 0 < found.read < found.postings / 2
    two = index.find("red blue", 3)
    assert two.among.count() < index._bounds(["red", "blue"], 1).count() / 2
    for lexemes in (["red", "blue"], ["red", "blue", "green"], ["red", "blue", "green", "gold"]):  # no score is above its bound
        scored = fulltext.match(rows, lexemes).select("chunk_id", fulltext.cover_density(F.col("hits"), len(lexemes)).alias("score"))
        assert scored.join(index._bounds(lexemes, 1), "chunk_id").where("score > bound + 1e-9").count() == 0
    plan = index.live(["red"], 8)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(n,8)" in plan and "tier" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_impact_segments(spark, tmp_path):
    old, new = _texts(2, 24), dict(_texts(3, 24))
    index = impact.ImpactIndex(spark, str(tmp_path / "i"), buckets=2)
    index.add(fulltext.postings(_frame(spark, old)))
    changed, deleted = [f"c{i:03}" for i in range(0, 24, 3)], ["c001", "tie1"]
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "i" / "postings" / "segment=1").rglob("*.parquet")}
    before = files()
    gone = spark.createDataFrame([(x,) for x in changed + deleted], "chunk_id string")
    assert index.add(fulltext.postings(_frame(spark, [(x, new[x]) for x in changed])), gone) == 2
    assert files() == before  # an update writes its own segment only
    now = {**dict(old), **{x: new[x] for x in changed}}
    rows = fulltext.postings(_frame(spark, [(k, v) for k, v in now.items() if k not in deleted])).cache()
    _same(index, rows)
    assert index.segments() == [1, 2] and index.merge() == 3 and index.segments() == [3]
    index.vacuum()
    assert not (tmp_path / "i" / "postings" / "segment=1").exists()
    _same(index, rows)
    index.add(rows.limit(0), spark.createDataFrame([("c002",)], "chunk_id string"))  # a deletion alone
    _same(index, rows.where("chunk_id <> 'c002'"), limits=(500,), queries=["red blue"])


def test_impact_refuses(spark, tmp_path, chunks):
    index = impact.ImpactIndex(spark, str(tmp_path / "i"), buckets=1)
    with pytest.raises(InvalidRequest):
        index.merge()
    rows = fulltext.postings(chunks.limit(3))
    late = index._claim()
    assert index.add(rows) == late + 1
    with pytest.raises(Conflict):
        index._write(late, rows, None, late)
    with pytest.raises(ConfigError):
        fulltext.search(index, "red", 3, stem=True)


def _names(spark):
    rows = [("1", "Alpha-Beta", "alpha"), ("2", "beta", None), ("3", None, "Gamma_1"), ("4", "100% pure", "x"), ("5", "", ""), ("6", "ALPHABETA", "ab"), ("7", "Gamma11", "g"), ("8", "ßtraße Ünit", "u"), ("8", "ßtraße Ünit", "u")]
    return spark.createDataFrame(rows, "id string, name string, display_name string")


TERMS = ["alpha", "ALPHA", "beta", "amma_1", "a%b", "pha%bet", "100\\%", "Gamma\\_1", "ab", "x", "", "%", "none", "traße", "üni", "alp_a"]


def test_substrings_equal_scan(spark, tmp_path):
    e = _names(spark)
    index = terms.SubstringIndex.write(e, str(tmp_path / "t"))
    for t in TERMS:
        assert index.seeds(t).collect() == graph.seeds(e, t).collect(), t
    want = sorted((t, r["id"]) for t in TERMS for r in graph.seeds(e, t, 1000).collect())
    got = sorted(map(tuple, index.match_many(spark.createDataFrame([(t,) for t in [*TERMS, "alpha", None]], "term string")).collect()))
    assert got == want
    assert index.candidates("amma_1").count() == 2 and index.candidates("ab") is None
    empty = terms.SubstringIndex.write(e.limit(0), str(tmp_path / "e"))
    assert empty.seeds("alpha").count() == 0 and empty.match_many(spark.createDataFrame([("alpha",)], "term string")).count() == 0


def test_short_terms_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(terms, "MAX_SCANNED", 2)
    index = terms.SubstringIndex.write(_names(spark), str(tmp_path / "t"))
    with pytest.raises(InvalidRequest):
        index.match_many(spark.createDataFrame([("a",), ("b",), ("c",)], "term string"))


def test_paths_equal_scan(spark, tmp_path):
    deep = {"v": 1}
    for _ in range(terms.DEPTH + 3):
        deep = {"d": deep}
    docs = [
        {"k": 1, "tags": ["a", "b"], "o": {"x": [1, 2, {"y": None}]}}, {"k": "1", "tags": ["b"]}, {"k": True, "o": {"x": []}}, {"k": 1, "tags": "a"},
        {"it's": 1, 'q"': {"a.b": 2}}, {"a": {"b": 2}}, {"a.b": 2}, {"parts": [{"a": 1, "b": 2}, {"a": 3, "b": 4}]}, {}, [1, 2], 5, "s", deep, {"k": 1},
    ]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, None), (91, "{broken"), (92, "")]
    df = spark.createDataFrame(rows, "id int, props string")
    index = terms.PathIndex.write(df, "props", str(tmp_path / "p"))
    wants = [
        {"k": 1}, {"k": "1"}, {"k": True}, {"tags": ["b"]}, {"tags": ["b", "a"]}, {"tags": []}, {"o": {"x": [2]}}, {"o": {"x": [{"y": None}]}}, {"o": {}}, {"it's": 1}, {'q"': {"a.b": 2}},
        {"a": {"b": 2}}, {"a.b": 2}, {"parts": [{"a": 1, "b": 2}]}, {"parts": [{"a": 1, "b": 4}]}, {"parts": [{"a": 3}, {"b": 2}]}, deep, {"k": 7}, {"d": {"d": {}}}, {},
    ]
    for w in wants:
        clause = filters.metadata_contains("props", w, nested=True)
        want = sorted(r["id"] for r in (df if clause is None else df.where(clause)).collect())
        assert sorted(r["id"] for r in index.containing(w).collect()) == want, w
    assert index.candidates({"parts": [{"a": 1, "b": 4}]}).count() == 1  # met by both values, refused by the row's own test
    assert terms.PathIndex.write(df.limit(0), "props", str(tmp_path / "e")).containing({"k": 1}).count() == 0


def test_json_terms_are_one_pass(spark):
    """A row is parsed once, not once for each level; scalars of every level up to the eighth have a term, empty parts none."""
    deep = 1
    for _ in range(terms.DEPTH):
        deep = {"k": deep}
    rows = ['{"a": [1, null, {"b": "x"}], "c": {}, "d": [], "e": {"f": true}}', "7", "[]", "no json", None, json.dumps(deep), json.dumps({"k": deep})]
    made = terms.json_terms(spark.createDataFrame(list(enumerate(rows)), "id int, v string"), "v")
    assert "Union" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = {"a": [1, None, {"b": "x"}], "e": {"f": True}}
    leaves = {0: terms._leaves(want), 1: terms._leaves(7), 5: terms._leaves(deep)}
    hashes = {i: sorted(spark.range(1).select(*[terms._key(F.lit(p), F.lit(v)).alias(str(n)) for n, (p, v) in enumerate(x)]).first()) for i, x in leaves.items()}
    got: dict = {}
    for r in made.collect():
        got.setdefault(r.id, []).append(r.term)
    assert {i: sorted(x) for i, x in got.items()} == hashes


def test_candidates_of_one_term_are_not_grouped(spark, tmp_path):
    index = terms.TermIndex(spark, str(tmp_path / "i"), "string").write(spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "b")], "term long, id string"))
    wants = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3), ("r", 1), ("r", 2), ("s", 9), ("s", 1)], "query string, term long")
    assert {tuple(r) for r in index.having_many(wants).collect()} == {("q", "b"), ("r", "a"), ("r", "b")}
    assert sorted(tuple(r) for r in index.having_many(wants, rarest=1).collect()) == [("q", "b"), ("r", "a"), ("r", "b")]


def test_postings_are_counted_in_their_tasks(spark, tmp_path):
    chunks = _frame(spark, [("a", "Red red the blue"), ("b", None), ("c", "the of"), ("d", "blue é 7 é")])
    rows = fulltext.postings(chunks)
    assert sorted((r.chunk_id, r.lexeme, r.positions) for r in rows.collect()) == [("a", "blue", [4]), ("a", "red", [1, 2]), ("d", "7", [3]), ("d", "blue", [1]), ("d", "é", [2, 4])]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
