"""Connectors as Spark data sources: partitions, pushed filters, streams."""

import json
import subprocess
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.plans.recorded import EPOCH, Recorded
from lodestone.sources import git, rest, scan


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def asked(log, ends):
    found = [json.loads(f.read_text()) for f in log.iterdir()]
    return [r for r in found if r["url"].endswith(ends)]


def test_filters_reach_the_requests(spark, sf, log):
    wiki = rest.Confluence({"base_url": "https://wiki"}, {"pat": "x"}, Recorded(sf, str(log)))
    refs = scan.read(spark, wiki)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every = docs.select("source").distinct().count()
    assert refs.rdd.getNumPartitions() == every > 1
    some = refs.where("slice in ('src1', 'src2', 'src3') and slice <> 'src2' and updated_at > timestamp '2024-01-01 01:00:00' and updated_at <= timestamp '2024-01-01 02:30:30'")
    got = {int(r.external_id) for r in some.collect()}
    want = {r.doc_id for r in docs.where("source in ('src1', 'src3') and doc_id > 60 and doc_id <= 150").collect()}
    assert got == want and got
    spaces = {r["cql"].partition('space = "')[2].partition('"')[0] for r in asked(log, "/content/search")}
    assert spaces == {"src1", "src2", "src3"}  # an inequality isn't pushed
    assert all('lastmodified >= "2024-01-01 01:00" AND lastmodified <= "2024-01-01 02:31"' in r["cql"] for r in asked(log, "/content/search"))
    assert refs.where("slice = 'none'").count() == 0 and refs.where("slice = 'src1' and slice = 'src3'").count() == 0


def test_pages_and_batches(spark, sf, log):
    tracker = rest.Jira({"base_url": "https://t", "project_keys": ["src1"]}, {"pat": "x"}, Recorded("/root/testdata/sf0.1", str(log)))
    got = scan.read(spark, tracker)
    n = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("source = 'src1'").count()
    assert got.count() == n > 3 * rest.PAGE and len(asked(log, "/api/3/search")) == -(-n // rest.PAGE)


def test_a_stream_lists_what_changed(spark, sf, tmp_path):
    clock = tmp_path / "clock"
    clock.write_text((EPOCH + timedelta(minutes=50)).isoformat())
    wiki = rest.Confluence({"base_url": "https://wiki"}, {"pat": "x"}, Recorded(sf), lambda: datetime.fromisoformat(clock.read_text()))
    out, seen = str(tmp_path / "out"), []
    for minutes in (50, 120, 120, 5000):
        clock.write_text((EPOCH + timedelta(minutes=minutes)).isoformat())
        stream = scan.read_stream(spark, wiki, EPOCH + timedelta(minutes=9))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()
        seen.append(spark.read.parquet(out).count())
    ids = sorted(int(r.external_id) for r in spark.read.parquet(out).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert ids == sorted(r.doc_id for r in docs.where("doc_id > 9").collect())  # each once, across restarts
    assert seen[0] < seen[1] == seen[2] < seen[3]


def test_slack_by_stretches(spark, sf):
    now = EPOCH + timedelta(days=3)
    one, many = (rest.Slack({"base_url": "https://c", "channels": ["src1", "src2"], "max_age_days": 3, **more}, {"bot_token": "t"}, Recorded(sf), lambda: now) for more in ({}, {"slice_days": 1}))
    assert len(one.slices()) == 2 and len(many.slices()) == 6
    ids = lambda c: sorted(r.external_id for r in scan.read(spark, c).collect())
    assert ids(one) == ids(many) and ids(one)


def test_git_by_directories(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for name in ("top.txt", "a/one.py", "a/b/two.py", "with space/é.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    run("add", "-A")
    run("commit", "-qm", "m")
    refs = scan.read(spark, git.GitConnector(str(tmp_path)))
    assert refs.rdd.getNumPartitions() == 3
    assert sorted((r.slice, r.external_id) for r in refs.collect()) == [("", "top.txt"), ("a/", "a/b/two.py"), ("a/", "a/one.py"), ("with space/", "with space/é.md")]


def test_the_general_source_checks_its_configuration(spark):
    scan.register(spark)
    with pytest.raises(Exception, match="secret"):
        spark.read.format("lodestone").option("connector", "slack").option("config", json.dumps({"channels": ["c"]})).load().count()
    with pytest.raises(Exception, match="no connector"):
        spark.read.format("lodestone").option("connector", "nothing").load().count()


def test_times_without_a_zone_are_utc():
    assert scan.aware(datetime(2024, 1, 1)) == datetime(2024, 1, 1, tzinfo=UTC) and scan.aware(None) is None
    assert rest.minute(datetime(2024, 1, 1, 1, 0, 1), True) == "2024-01-01 01:01" and rest.minute(datetime(2024, 1, 1, 1, 0), True) == "2024-01-01 01:00"


def test_recorded_services_hold_a_source_as_columns(sf):
    """A worker holds the documents of the source it lists, as two columns; pages are those of the whole table."""
    from datetime import UTC, datetime, timedelta

    import pyarrow.parquet as pq

    from lodestone.plans import recorded

    start = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(r["doc_id"], r["n_chars"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "source", "n_chars"]).to_pylist() if r["source"] == "src1"]
    held = recorded._source(f"{sf}/documents.parquet", "src1")
    assert held.rows.num_rows == len(rows) and held.rows.nbytes <= 24 * len(rows)
    low, high = start + timedelta(minutes=15), start + timedelta(minutes=170)
    want = [(start + timedelta(minutes=d), d, n) for d, n in sorted(rows) if 15 <= d <= 170]
    assert held.page(held.between(recorded._since(low), recorded._since(high))) == want and want
    jql = {"jql": 'project in (src1) and updated >= "2024-01-01 00:15"', "maxResults": 2, "startAt": "1"}
    got = recorded.Recorded(sf)("https://t/api/3/search", jql, {})
    late = [d for d, _ in sorted(rows) if d >= 15]
    assert got["total"] == len(late) and [i["key"] for i in got["issues"]] == [f"src1-{d}" for d in late[1:3]]
    assert recorded.Recorded(sf)("https://t/api/3/search", jql | {"jql": "project in (none)"}, {}) == {"issues": [], "total": 0}
