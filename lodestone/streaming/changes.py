"""Change events as streams. Every step works on batch DataFrames too, which is how it is tested and back-filled."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Collection, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schema import CHANGE_EVENTS

REPLAY_SECONDS, LATE_SECONDS, MAX_DELIVER, BATCH = 300, 300, 5, 10
TOKEN_RPM, WEBHOOK_RPM = 60, 120
DELIVERY_HEADERS = ["x-github-delivery", "x-gitlab-event-uuid"]


def read_events(spark: SparkSession, path: str, *, max_files: int = BATCH, format: str = "json") -> DataFrame:
    """The change stream from files; each trigger takes ``max_files`` at most (back-pressure)."""
    return spark.readStream.schema(CHANGE_EVENTS).option("maxFilesPerTrigger", max_files).format(format).load(path)


def publish(events: DataFrame, path: str, checkpoint: str):
    """Writes valid events as JSON, partitioned by source type; the checkpoint makes it exactly once."""
    valid = events.where("source_id is not null and external_id is not null and action in ('created', 'updated', 'deleted')")
    return valid.writeStream.format("json").partitionBy("source_type").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def delivery_id(headers: Column) -> Column:
    return F.coalesce(*[F.try_element_at(headers, F.lit(h)) for h in DELIVERY_HEADERS])


def drop_replays(stream: DataFrame, id: str = "delivery_id", at: str = "at", seconds: int = REPLAY_SECONDS) -> DataFrame:
    """First deliveries of a stream: one that repeats a delivery seen at most ``seconds`` before goes, and counts as seen then.

    The last time of each id is state, which is dropped when the watermark has passed the window. Rows without an id stay.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(at)
        (last,) = state.get if state.exists else (None,)
        kept = []
        for t in rows[at]:
            now = t.timestamp()
            kept.append(last is None or not 0 <= now - last <= seconds)
            last = now if last is None else max(last, now)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last * 1000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[kept]

    marked = stream.withWatermark(at, f"{seconds} seconds")
    held = marked.where(F.col(id).isNotNull()).groupBy(id).applyInPandasWithState(run, stream.schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)
    return held.unionByName(stream.where(F.col(id).isNull()))


def mark_replays(rows: DataFrame, id: str = "delivery_id", at: str = "at", seconds: int = REPLAY_SECONDS) -> DataFrame:
    """Batch form with refresh: a delivery repeats one seen at most ``seconds`` before, which itself counts as seen then."""
    last = F.lag(at).over(Window.partitionBy(id).orderBy(at))
    age = F.unix_micros(F.col(at)) - F.unix_micros(last)
    return rows.withColumn("duplicate", F.coalesce(age <= seconds * 1_000_000, F.lit(False)))


def payload_time(payload: Column) -> Column:
    """Epoch seconds in a JSON payload: the first numeric of timestamp, created_at, pushed_at."""
    v = F.try_parse_json(payload)
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "double") for k in ("timestamp", "created_at", "pushed_at")])


def is_late(event_seconds: Column, now_seconds: Column, seconds: int = LATE_SECONDS) -> Column:
    """Strictly older than the window; without a time nothing is late."""
    return F.coalesce(now_seconds - event_seconds > seconds, F.lit(False))


def token_bucket(rows: DataFrame, *, key: str = "key", at: str = "at", rpm: int = TOKEN_RPM) -> DataFrame:
    """Each row with ``allowed``, ``remaining`` and ``retry_after``: capacity rpm, rpm / 60 tokens a second, one a request.

    Batch form: a key's requests in order of time. A bucket is sequential by nature, so one key stays in one task, streamed.
    """
    schema = T.StructType(list(rows.schema.fields)).add("allowed", "boolean").add("remaining", "double").add("retry_after", "double")

    # One sort by key and time serves all keys of a partition; the state is two numbers.
    ordered = rows.repartition(F.col(key)).sortWithinPartitions(key, at)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"key": object(), "tokens": 0.0, "last": 0.0}
        for batch in batches:
            allowed, remaining, wait = [], [], []
            for k, t in zip(batch[key], batch[at]):
                now = t.timestamp()
                if k != state["key"]:
                    state = {"key": k, "tokens": float(rpm), "last": now}
                tokens = min(float(rpm), state["tokens"] + (now - state["last"]) * rpm / 60)
                ok = tokens >= 1
                tokens -= ok
                state["tokens"], state["last"] = tokens, now
                allowed.append(ok), remaining.append(tokens), wait.append(0.0 if ok else (1 - tokens) * 60 / rpm)
            yield batch.assign(allowed=allowed, remaining=remaining, retry_after=wait)

    return ordered.mapInPandas(sweep, schema)


def token_bucket_stream(stream: DataFrame, *, key: str = "key", at: str = "at", rpm: int = TOKEN_RPM) -> DataFrame:
    """Streaming form: the bucket of a key is state, and idles out once it would be full again."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    schema = T.StructType(list(stream.schema.fields)).add("allowed", "boolean").add("remaining", "double").add("retry_after", "double")

    def run(_, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(at)
        tokens, last = state.get if state.exists else (float(rpm), None)
        out = []
        for t in rows[at]:
            now = t.timestamp()
            tokens = tokens if last is None else min(float(rpm), tokens + max(0.0, now - last) * rpm / 60)
            last, ok = now, tokens >= 1
            tokens -= ok
            out.append((ok, tokens, 0.0 if ok else (1 - tokens) * 60 / rpm))
        state.update((tokens, last))
        state.setTimeoutDuration(120_000)
        allowed, remaining, wait = zip(*out)
        yield rows.assign(allowed=allowed, remaining=remaining, retry_after=wait)

    return stream.groupBy(key).applyInPandasWithState(run, schema, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def split_dead_letters(messages: DataFrame, max_deliver: int = MAX_DELIVER) -> tuple[DataFrame, DataFrame]:
    """(to process, dead letters): a message at its ``max_deliver``-th delivery isn't processed any more."""
    dead = F.col("attempt") >= max_deliver
    return messages.where(~dead), messages.where(dead).withColumn("reason", F.lit("max_deliver"))


def sign(secret: str, body: bytes) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def signature(kind: str, secret: str, body: bytes, stamp: str | None = None) -> str:
    """What a service of ``kind`` signs a request with: a token for gitlab, an HMAC of time and body for slack, of the body else."""
    if kind == "gitlab":
        return secret
    if kind == "slack":
        return "v0=" + hmac.new(secret.encode(), f"v0:{stamp}:".encode() + body, hashlib.sha256).hexdigest()
    return sign(secret, body)


def verified(kind: Column, body: Column, given: Column, timestamp: Column, secrets: dict[str, str], now: datetime, unsigned: Collection[str] = ()) -> Column:
    """Whether a webhook's signature holds, by source type (see :func:`signature`); slack's are at most 300 s old. A type
    without a secret doesn't pass, unless it is in ``unsigned``, whose requests are not checked."""

    @F.pandas_udf("boolean")
    def check(kinds: pd.Series, bodies: pd.Series, signatures: pd.Series, stamps: pd.Series) -> pd.Series:
        def one(k, b, s, t) -> bool:
            if k in unsigned:
                return True
            secret = secrets.get(k)
            if not secret or s is None or b is None:
                return False
            if k == "slack":
                try:
                    if abs(now.timestamp() - float(t)) > LATE_SECONDS:
                        return False
                except (TypeError, ValueError):
                    return False
            return hmac.compare_digest(signature(k, secret, b.encode(), t).encode(), s.encode())

        return pd.Series([one(*r) for r in zip(kinds, bodies, signatures, stamps)])

    return check(kind, body, given, timestamp)


_PUSH = "struct<commits:array<struct<id:string,added:array<string>,modified:array<string>,removed:array<string>>>>"


def push_refs(pushes: DataFrame, body: str = "body") -> DataFrame:
    """Affected files of push payloads: other columns, external_id, path, action. The first occurrence of a path counts, in
    the order of commits and of added, modified, removed; removed files are deletions, and a push without files is one ``*``."""
    other = [c for c in pushes.columns if c != body]
    parsed = pushes.withColumn("__id", F.xxhash64(body)).select(*other, "__id", F.from_json(F.col(body), _PUSH).alias("p"))
    commits = parsed.select(*other, "__id", F.posexplode_outer("p.commits").alias("i", "c"))
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.coalesce(F.col(f"c.{k}"), F.array().cast("array<string>")).alias("paths")) for k, a in (("added", "created"), ("modified", "updated"), ("removed", "deleted"))])
    files = commits.select(*other, "__id", "i", "c.id", F.posexplode(kinds).alias("j", "x")).select(*other, "__id", "i", "id", "j", "x.a", F.posexplode("x.paths").alias("n", "path"))
    first = files.groupBy(*other, "__id", "path").agg(F.min_by(F.struct("id", "a"), F.struct("i", "j", "n")).alias("f"))
    refs = first.select(*other, "__id", F.concat_ws(":", "f.id", "path").alias("external_id"), "path", F.col("f.a").alias("action"))
    bare = parsed.join(refs.select("__id").distinct(), "__id", "left_anti").select(*other, "__id", F.lit("*").alias("external_id"), F.lit("*").alias("path"), F.lit("updated").alias("action"))
    return refs.unionByName(bare).drop("__id")


def webhook_status(requests: DataFrame, secrets: dict[str, str], now: datetime, *, unsigned: Collection[str] = (), rpm: int = WEBHOOK_RPM) -> DataFrame:
    """``requests`` (source_id, source_type, headers, body, signature, stamp, at) with delivery_id and status, the first that
    holds: rate_limited (over ``rpm`` a minute for the source), unauthorized, late, replayed or accepted. Only rows that are
    authorized and in time count as deliveries."""
    # A bucket of its source decides on each request; only what it needs goes to Python.
    numbered = requests.withColumn("__n", F.struct("at", F.xxhash64("body", "signature", "stamp", F.map_entries("headers"))))
    order = Window.partitionBy("source_id").orderBy("__n")
    numbered = numbered.withColumn("__k", F.row_number().over(order)).drop("__n")
    judged = token_bucket(numbered.select(F.coalesce("source_id", F.lit("")).alias("key"), F.col("source_id").isNull().alias("__none"), "at", "__k"), rpm=rpm)
    judged = judged.select(F.when(~F.col("__none"), F.col("key")).alias("__s"), F.col("__k").alias("__j"), "allowed")
    r = numbered.join(judged, F.col("source_id").eqNullSafe(F.col("__s")) & (F.col("__k") == F.col("__j"))).drop("__s", "__j", "__k")
    r = r.withColumn("delivery_id", delivery_id(F.col("headers")))
    ok = verified(F.col("source_type"), F.col("body"), F.col("signature"), F.col("stamp"), secrets, now, unsigned)
    late = is_late(payload_time(F.col("body")), F.unix_micros("at") / 1e6)
    r = r.withColumn("__state", F.when(~F.col("allowed"), "rate_limited").when(~ok, "unauthorized").when(late, "late").otherwise("accepted")).drop("allowed")
    key = F.when((F.col("__state") == "accepted") & F.col("delivery_id").isNotNull(), F.col("delivery_id")).otherwise(F.concat(F.lit("\0"), F.uuid()))
    marked = mark_replays(r.withColumn("__key", key), id="__key")
    status = F.when((F.col("__state") == "accepted") & F.col("duplicate"), "replayed").otherwise(F.col("__state"))
    return marked.withColumn("status", status).drop("__state", "__key", "duplicate")


def webhook_events(requests: DataFrame, secrets: dict[str, str], now: datetime, *, unsigned: Collection[str] = (), rpm: int = WEBHOOK_RPM) -> DataFrame:
    """Change events of the accepted requests: files of push payloads, ordered by their time."""
    taken = webhook_status(requests, secrets, now, unsigned=unsigned, rpm=rpm).where("status = 'accepted'")
    refs = push_refs(taken.select("source_id", "source_type", F.unix_micros("at").alias("seq"), "body"))
    return refs.select("source_id", "source_type", "external_id", F.col("path").alias("uri"), "action", "seq", F.lit(1).cast("long").alias("attempt"))


def replace_files(rows: DataFrame, folder: str, name: str) -> None:
    """``rows`` as JSON files ``name-0.json`` ... in ``folder``, instead of those that it has of this name. A stream that reads
    the folder sees whole files only, and one that comes back under a name it knows not at all."""
    jvm = rows.sparkSession.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    draft = make(f"{folder}/_{name}")
    fs = draft.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").json(draft.toString())
    for old in fs.globStatus(make(f"{folder}/{name}-*.json")) or ():
        fs.delete(old.getPath(), False)
    parts = sorted(s.getPath().toString() for s in fs.listStatus(draft) if s.getPath().getName().startswith("part-") and s.getLen())
    for k, part in enumerate(parts):
        fs.rename(make(part), make(f"{folder}/{name}-{k}.json"))
    fs.delete(draft, True)


def retire(spark: SparkSession, folder: str, older_than_seconds: int, now: datetime) -> int:
    """Deletes event files of ``folder`` that were last changed so long before ``now``; returns how many. Streams that are that
    far behind miss them, as a stream's retention has it."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, gone, limit = fs.listFiles(make(folder), True), 0, (now.timestamp() - older_than_seconds) * 1000
    while files.hasNext():
        at = files.next()
        inner = at.getPath().toString()[len(make(folder).toString()) :]
        if at.getModificationTime() < limit and not any(x.startswith(("_", ".")) for x in inner.split("/")):
            gone += bool(fs.delete(at.getPath(), False))
    return gone


def run_pipeline(stream: DataFrame, apply: Callable[[DataFrame, int], DataFrame | None], checkpoint: str, *, retry: str | None = None, dead_letters: str | None = None, max_deliver: int = MAX_DELIVER):
    """Latest event of each document per micro-batch, by ``seq``, then ``apply`` (upserts and tombstones are idempotent, so at
    least once is enough).

    ``apply`` may return the events that failed (source_id, external_id, error): they are delivered again by JSON files in
    ``retry`` (the folder that the stream reads), with ``attempt`` one higher, and in their ``max_deliver``-th attempt go to
    ``dead_letters`` instead.
    """
    from lodestone.operators.ingest import latest

    if "seq" not in stream.columns:
        raise ValueError("change events need the column seq, which orders them")

    def each(batch: DataFrame, epoch: int) -> None:
        todo = latest(batch)
        failed = apply(todo, epoch)
        if failed is None or not retry and not dead_letters:
            return
        again = todo.join(failed.select("source_id", "external_id", "error"), ["source_id", "external_id"])
        again = again.withColumn("attempt", F.coalesce("attempt", F.lit(1)).cast("long"))
        dead = F.col("attempt") >= max_deliver
        # A batch that is run again writes over its own files, which the stream has not read yet or knows by name.
        if dead_letters:
            again.where(dead).withColumn("reason", F.lit("max_deliver")).write.mode("overwrite").json(f"{dead_letters}/batch={epoch}")
        if retry:
            replace_files(again.where(~dead).withColumn("attempt", F.col("attempt") + 1).drop("error"), retry, f"retry-{hashlib.sha1(checkpoint.encode()).hexdigest()[:12]}-{epoch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
