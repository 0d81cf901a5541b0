"""Tables in buckets: what a delta reads, writes and leaves alone."""

from datetime import UTC, datetime

import pytest

from lodestone.errors import InvalidRequest
from lodestone.operators import graph, writer
from lodestone.operators.buckets import BucketTable

NOW = datetime(2024, 1, 8, tzinfo=UTC)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.glob("bucket=*/*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    at = tmp_path / "t"
    t = BucketTable(spark, str(at), ["k"], buckets=16).create(spark.range(200).selectExpr("id as k", "id * 2 as v"))
    before = files(at)
    delta = spark.createDataFrame([(3, -1), (3, -1), (500, 7)], "k long, v long")
    touched = t.replace(delta.select("k"), delta.distinct())
    assert touched == t.touched(delta) and 1 <= len(touched) <= 2
    after = files(at)
    same = {f for f in before if after.get(f) == before[f]}
    assert {int(f.split("/")[0][7:]) for f in before.keys() - same} <= set(touched) and {int(f.split("/")[0][7:]) for f in after.keys() - same} == set(touched)
    assert {(r.k, r.v) for r in t.all().collect()} == {(k, 2 * k) for k in range(200) if k != 3} | {(3, -1), (500, 7)}
    plan = t.near(delta)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:60]
    # A bucket that loses its last row is gone, not what it was.
    one = t.touched(spark.createDataFrame([(3,)], "k long"))[0]
    t.replace(t.all().where(f"pmod(xxhash64(k), 16) = {one}").select("k"), delta.limit(0))
    assert not (at / f"bucket={one}").exists() and t.all().where("k = 3").count() == 0 and t.near(spark.createDataFrame([(3,)], "k long")).count() == 0
    assert t.replace(delta.limit(0).select("k"), delta.limit(0)) == []
    with pytest.raises(InvalidRequest):
        BucketTable(spark, str(at), ["k"], by=["v"])


def test_upsert_in_buckets_equals_an_upsert_of_the_table(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(list(rows), "source_id string, external_id string, text string")
    empty = spark.createDataFrame([], "id string, source_id string, external_id string, content_hash string, doc_version long, indexed_at timestamp, tombstoned_at timestamp")
    first = writer.upsert_documents(empty, docs(*[("s", f"d{k}", f"text {k}") for k in range(30)]), NOW)
    t = BucketTable(spark, str(tmp_path / "t"), writer.KEY, buckets=32).create(first)
    incoming = docs(("s", "d1", "text 1"), ("s", "d2", "other"), ("s", "new", "text"))
    want = {tuple(r) for r in writer.upsert_documents(t.all(), incoming, NOW).collect()}
    written = writer.upsert_in_buckets(t, incoming, NOW)
    assert {tuple(r) for r in t.all().select(*first.columns).collect()} == want
    assert set(written) <= set(t.touched(incoming)) and set(written) == set(t.touched(docs(("s", "d2", ""), ("s", "new", ""))))
    assert writer.upsert_in_buckets(t, incoming, NOW) == []


def test_links_from_a_stored_index(spark, tmp_path):
    names = ["aws_payments_api", "payments-api service", "orders db main", "orders_db_main replica", "cache", "cache", "x"]
    kinds = ["terraform_resource", "k8s_resource"]
    rows = [(f"{s}{k}", s, kinds[s == "b"], f"{n} {k % 3}", f"{n} {k % 3}") for s in "abc" for k, n in enumerate(names * 3)]
    every = spark.createDataFrame(rows, "id string, source_id string, entity_type string, name string, display_name string")
    signed = graph.signatures(every, {})
    index = BucketTable(spark, str(tmp_path / "i"), ["meets", "id"], by=["meets"]).create(signed.where("source_id = 'a'"))
    pair = lambda df: {(r.source_entity_id, r.target_entity_id, r.strategy, round(r.score, 6)) for r in df.collect()}
    found = set()
    for source in "bc":
        found |= pair(graph.link_stored(index, signed.limit(0), signed.where(f"source_id = '{source}'")))
    assert found == pair(graph.link_sources(every)) and found
    # One entity: a few buckets of the index are read, and its old signatures go.
    new = signed.where("id = 'b0'")
    assert len(index.touched(new)) < 20 and index.near(new).count() < index.all().count()
    again = pair(graph.link_stored(index, new, new))
    assert again == {p for p in found if "b0" in p[:2]} and index.all().where("id = 'b0'").count() == new.count()
