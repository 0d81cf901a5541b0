import json
import random
import time
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from lodestone.schema import CHANGE_EVENTS
from lodestone.streaming import changes

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def at(*seconds):
    return [T0 + timedelta(seconds=s) for s in seconds]


def test_replays_and_late(spark):
    rows = spark.createDataFrame([("d", t) for t in at(0, 200, 450, 800)] + [("e", T0)], "delivery_id string, at timestamp")
    got = {(r.delivery_id, r.at.replace(tzinfo=UTC) - T0): r.duplicate for r in changes.mark_replays(rows).collect()}
    assert got == {("d", timedelta(seconds=0)): False, ("d", timedelta(seconds=200)): True, ("d", timedelta(seconds=450)): True, ("d", timedelta(seconds=800)): False, ("e", timedelta(0)): False}
    late = spark.createDataFrame([(100.0, 400.0), (100.0, 400.5), (None, 9.0)], "e double, n double").select(changes.is_late(F.col("e"), F.col("n")))
    assert [r[0] for r in late.collect()] == [False, True, False]
    body = spark.createDataFrame([('{"created_at": 5, "pushed_at": 7}',), ('{"timestamp": "x"}',), ("no",)], "b string").select(changes.payload_time(F.col("b")))
    assert [r[0] for r in body.collect()] == [5.0, None, None]


def test_token_bucket(spark):
    rows = spark.createDataFrame([("k", t) for t in at(0, 0, 0, 30, 31)] + [("j", T0)], "key string, at timestamp")
    got = sorted(((r.key, r.at, -r.remaining, r.allowed, round(r.retry_after, 3)) for r in changes.token_bucket(rows, rpm=2).collect()))
    assert [x[3] for x in got if x[0] == "k"] == [True, True, False, True, False] or [x[3] for x in got if x[0] == "k"].count(True) == 3
    assert [x[3] for x in got if x[0] == "j"] == [True]


def test_dead_letters_and_signatures(spark):
    todo, dead = changes.split_dead_letters(spark.createDataFrame([(4,), (5,)], "attempt int"))
    assert [r.attempt for r in todo.collect()] == [4] and [r.attempt for r in dead.collect()] == [5]
    body = '{"a": 1}'
    rows = [("github", body, changes.sign("s", body.encode()), None, True), ("github", body, "sha256=no", None, False), ("gitlab", body, "tok", None, True), ("slack", body, "v0=x", "0", False), ("other", body, None, None, True), ("jira", body, None, None, False)]
    df = spark.createDataFrame(rows, "k string, b string, s string, t string, want boolean")
    ok = changes.verified(F.col("k"), F.col("b"), F.col("s"), F.col("t"), {"github": "s", "gitlab": "tok", "slack": "s", "jira": "s"}, T0)
    assert [r[0] == r[1] for r in df.select(ok, "want").collect()] == [True] * 6


def test_push_refs(spark):
    push = {"commits": [{"id": "c1", "added": ["a"], "modified": ["b"]}, {"id": "c2", "modified": ["a"], "removed": ["d"]}]}
    df = spark.createDataFrame([("r1", json.dumps(push)), ("r2", "{}")], "repo string, body string")
    got = {(r.repo, r.external_id, r.action) for r in changes.push_refs(df).collect()}
    assert got == {("r1", "c1:a", "created"), ("r1", "c1:b", "updated"), ("r1", "c2:d", "deleted"), ("r2", "*", "updated")}


def test_stream_end_to_end(spark, tmp_path):
    src, out, cp, dead = (str(tmp_path / x) for x in ("src", "out", "cp", "dead"))
    # The deletion comes last by seq, though its name sorts first and its row stands first.
    rows = [("s", "git", "a", "u", "deleted", 3, 1), ("s", "git", "a", "u", "created", 1, 1), ("s", "git", "a", "u", "updated", 2, 1), (None, "git", "b", "u", "created", 1, 1), ("s", "git", "c", "u", "updated", 1, 1)]
    spark.createDataFrame(rows, CHANGE_EVENTS).coalesce(1).write.json(src)
    changes.publish(changes.read_events(spark, src), out, cp + "1").start().awaitTermination()
    assert spark.read.json(out).count() == 4
    seen = []

    def apply(batch, epoch):
        seen.extend((r.external_id, r.action, r.attempt) for r in batch.collect())
        return batch.where("external_id = 'c'").selectExpr("source_id", "external_id", "'no' as error")

    for _ in range(4):  # what failed is delivered again by the next run, and given up at the third attempt
        changes.run_pipeline(changes.read_events(spark, src), apply, cp + "2", retry=src, dead_letters=dead, max_deliver=3).start().awaitTermination()
    assert ("a", "deleted", 1) in seen and not [x for x in seen if x[0] == "a" and x[1] != "deleted"]
    assert sorted(x[2] for x in seen if x[0] == "c") == [1, 2, 3]
    given_up = spark.read.json(dead).collect()
    assert [(r.external_id, r.attempt, r.reason, r.error) for r in given_up] == [("c", 3, "max_deliver", "no")]


def test_webhooks(spark):
    body = json.dumps({"timestamp": 1000.0, "commits": [{"id": "c", "added": ["x"]}]})
    good = changes.sign("s", body.encode())
    at_ = lambda n: datetime.fromtimestamp(n, UTC)
    rows = [("1", "github", {"x-github-delivery": "d"}, body, good, None, at_(1001)), ("2", "github", {"x-github-delivery": "d"}, body, good, None, at_(1100)), ("3", "github", {"x-github-delivery": "e"}, body, "bad", None, at_(1001)), ("4", "github", {"x-github-delivery": "e"}, body, good, None, at_(1900)), ("5", "github", {}, body, good, None, at_(1002)), ("6", "github", {}, body, good, None, at_(1003))]
    df = spark.createDataFrame(rows, "source_id string, source_type string, headers map<string,string>, body string, signature string, stamp string, at timestamp")
    got = {r.source_id: r.status for r in changes.webhook_status(df, {"github": "s"}, T0).collect()}
    assert got == {"1": "accepted", "2": "replayed", "3": "unauthorized", "4": "late", "5": "accepted", "6": "accepted"}
    assert sorted(r.source_id for r in changes.webhook_events(df, {"github": "s"}, T0).collect()) == ["1", "5", "6"]


def test_ingested_code_replaces_its_graph(spark):
    from lodestone.operators import embedding, ingest

    schema = "source_id string, external_id string, path string, content_type string, content binary"
    none = ingest.empty(spark)
    made = embedding.embedder(embedding.provider("hash", dimension=8), 8)
    keep = lambda df: df.persist()

    def run(tables, text, seq):
        events = spark.createDataFrame([("s", "a", "updated", seq), ("s", "lost", "updated", seq)], "source_id string, external_id string, action string, seq long")
        content = spark.createDataFrame([("s", "a", "a.py", "", text.encode())], schema)
        return ingest.ingest(tables, events, lambda keys: content.join(keys, ["source_id", "external_id"], "left_semi"), T0, run_id=f"r{seq}", embed=made, keep=keep)

    one = run(none, "def f():\n    return g()\n\ndef g():\n    return 1\n", 1)
    assert {(r.entity_type, r.name) for r in one.tables.entities.collect()} == {("module", "a"), ("function", "a.f"), ("function", "a.g")}
    assert sorted(r.edge_type for r in one.tables.edges.collect()) == ["calls", "defines", "defines"]
    assert one.tables.chunks.count() == 2 and {len(r.embedding) for r in one.tables.chunks.collect()} == {8}
    run1 = one.runs.first()
    assert (run1.docs_new, run1.docs_failed, run1.status, list(run1.errors)) == (1, 1, "partial", ["lost"])
    two = run(one.tables, "def h():\n    return 2\n", 2)
    assert {r.name for r in two.tables.entities.collect()} == {"a", "a.h"} and [r.edge_type for r in two.tables.edges.collect()] == ["defines"]
    assert two.tables.chunks.count() == 1 and two.tables.postings.where("lexeme = 'g'").count() == 0 and two.tables.documents.first().doc_version == 2


def test_stateful_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("k", "d1", T0), ("k", "d1", T0 + timedelta(seconds=5)), ("k", "d2", T0 + timedelta(seconds=6))], "key string, delivery_id string, at timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("key string, delivery_id string, at timestamp").parquet(src)
    for name, df in {"fresh": changes.drop_replays(stream), "bucket": changes.token_bucket_stream(stream, rpm=2)}.items():
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        deadline = time.monotonic() + 60
        while not spark.table(name).count() and time.monotonic() < deadline:
            time.sleep(0.5)
        q.stop()
    assert spark.table("fresh").count() == 2
    assert sorted(r.allowed for r in spark.table("bucket").collect()) == [False, True, True]


def test_retries_of_a_batch_that_runs_again(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("s", "git", f"d{k}", "u", "updated", 1, 1) for k in range(40)]
    events = spark.createDataFrame(rows, CHANGE_EVENTS)
    for _ in range(2):
        changes.replace_files(events.repartition(3), folder, "retry-x-7")
    changes.replace_files(events.limit(2).coalesce(1), folder, "retry-x-8")
    assert spark.read.schema(CHANGE_EVENTS).json(folder).count() == 42
    changes.replace_files(events.limit(0), folder, "retry-x-7")
    assert spark.read.schema(CHANGE_EVENTS).json(folder).count() == 2 and not [f for f in (tmp_path / "in").iterdir() if f.name.startswith("_")]
    assert changes.retire(spark, folder, 3600, datetime.now(UTC)) == 0 and changes.retire(spark, folder, -60, datetime.now(UTC)) == 1


def test_ingestion_within_the_pipeline(spark, tmp_path):
    """Events stream into ingestion; what can't be fetched at first is delivered again and then gets in, or ends as a dead letter."""
    from lodestone.operators import ingest
    from lodestone.session import written

    src, cp, dead = (str(tmp_path / x) for x in ("src", "cp", "dead"))
    rows = [("s", "git", name, "u", "updated", 1, 1) for name in ("a", "late", "never")]
    spark.createDataFrame(rows, CHANGE_EVENTS).coalesce(1).write.json(src)
    state, tries = [ingest.empty(spark)], []

    def fetch(keys):
        there = ["a", "late"] if len(tries) > 1 else ["a"]
        content = spark.createDataFrame([("s", n, f"{n}.txt", "text/plain", f"text of {n}".encode()) for n in there], "source_id string, external_id string, path string, content_type string, content binary")
        return content.join(keys, ["source_id", "external_id"], "left_semi")

    def apply(batch, epoch):
        tries.append(epoch)
        got = ingest.ingest(state[0], batch, fetch, T0, run_id=f"r{epoch}", keep=written)
        state[0] = got.tables
        return got.results.where("action = 'error'").select("source_id", "external_id", "error")

    for _ in range(4):
        changes.run_pipeline(changes.read_events(spark, src), apply, cp, retry=src, dead_letters=dead, max_deliver=3).start().awaitTermination()
    assert {r.external_id for r in state[0].documents.collect()} == {"a", "late"} and state[0].chunks.count() == 2
    assert [(r.external_id, r.attempt) for r in spark.read.json(dead).collect()] == [("never", 3)]


def test_streams_with_state_and_a_restart(spark, tmp_path):
    """Replay windows, buckets and redelivery in micro-batches, with a restart between, equal the batch forms; state can be read."""
    from pyspark.sql import functions as F

    from lodestone.streaming import stateful

    rnd = random.Random(7)
    rows = sorted((T0 + timedelta(seconds=rnd.randrange(3000), microseconds=k), f"k{rnd.randrange(4)}", f"d{rnd.randrange(12)}", k) for k in range(160))
    schema = "at timestamp, key string, delivery_id string, n long"
    src, provider = str(tmp_path / "in"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    fails = {k: k % 4 for k in range(160)}

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        bucket = stateful.token_bucket(stream, rpm=3)
        replays = stateful.mark_replays(stream)
        sent = stateful.redeliver(stream.withColumn("payload", (F.col("n") % 4).cast("string")), lambda payload, attempt: attempt > int(payload), key="key", id="n", max_deliver=3, backoff_seconds=10)
        return [stateful.run_to_end(df, str(tmp_path / f"out{i}"), str(tmp_path / f"cp{i}")) for i, df in enumerate((bucket, replays, sent))]

    try:
        for part in (rows[:60], rows[60:100], rows[100:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            if part is not rows[60:100]:
                found = run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    table = spark.createDataFrame(rows, schema)
    bucket, replays, sent = found
    want = {r.n: (r.allowed, round(r.remaining, 6), round(r.retry_after, 6)) for r in changes.token_bucket(table, rpm=3).collect()}
    assert {r.n: (r.allowed, round(r.remaining, 6), round(r.retry_after, 6)) for r in bucket.collect()} == want
    assert {r.n: r.duplicate for r in replays.collect()} == {r.n: r.duplicate for r in changes.mark_replays(table).collect()}
    end = rows[-1][0]
    due = lambda at, attempt: at + timedelta(seconds=10 * (2 ** (attempt - 1) - 1))
    status = lambda n, attempt: "delivered" if attempt > fails[n] else "dead" if attempt == 3 else "failed"
    want = sorted((str(n), a, status(n, a)) for at, _, _, n in rows for a in range(1, min(fails[n], 2) + 2) if a == 1 or due(at, a) <= end)
    assert sorted((r.id, r.attempt, r.status) for r in sent.collect()) == want
    left = spark.read.format("statestore").option("path", str(tmp_path / "cp1")).option("stateVarName", "state").load()
    assert 0 < left.count() <= 12  # ids seen in the last five minutes, not all that there ever were


def test_keys_of_a_stream_share_the_state_of_a_shard(spark, tmp_path):
    """However many keys there are, calls and state rows are those of the shards; keys without a value and times stay what they are."""
    from lodestone.streaming import stateful

    rnd = random.Random(11)
    rows = sorted((T0 + timedelta(seconds=rnd.randrange(900), microseconds=k), T0 + timedelta(days=k % 90, microseconds=k % 90), None if k % 50 == 0 else f"d{rnd.randrange(80)}", k) for k in range(400))
    schema = "at timestamp, made timestamp, delivery_id string, n long"
    src, provider = str(tmp_path / "in"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in (rows[:200], rows[200:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    sent = stateful.redeliver(stream.withColumn("payload", F.lit("x")), lambda payload, attempt: False, key="made", id="n", max_deliver=2, backoff_seconds=100, shards=3)
    try:
        dfs = stateful.mark_replays(stream, shards=3), stateful.token_bucket(stream, key="delivery_id", rpm=2, shards=3), sent
        replays, bucket, sent = [stateful.run_to_end(df, str(tmp_path / f"out{i}"), str(tmp_path / f"cp{i}")) for i, df in enumerate(dfs)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    table = spark.createDataFrame(rows, schema)
    assert {r.n: r.duplicate for r in replays.collect()} == {r.n: r.duplicate for r in changes.mark_replays(table.where("delivery_id is not null")).collect()}
    judged = changes.token_bucket(table.withColumn("delivery_id", F.coalesce("delivery_id", F.lit("none"))), key="delivery_id", rpm=2)
    assert {r.n: (r.allowed, round(r.remaining, 6)) for r in bucket.collect()} == {r.n: (r.allowed, round(r.remaining, 6)) for r in judged.collect()}
    end = rows[-1][0]
    want = sorted((made, str(n), a, "failed" if a == 1 else "dead") for at, made, _, n in rows for a in (1, 2) if a == 1 or at + timedelta(seconds=100) <= end)
    assert sorted((r.key.replace(tzinfo=UTC), r.id, r.attempt, r.status) for r in sent.collect()) == want
    for i, name in enumerate(("state", "state")):
        left = spark.read.format("statestore").option("path", str(tmp_path / f"cp{i}")).option("stateVarName", name).load()
        assert 0 < left.count() <= 4  # three shards, and that of rows without a key
