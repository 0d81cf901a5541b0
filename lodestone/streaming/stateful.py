"""Streams with state of their own, kept in RocksDB: replay windows, token buckets and redelivery with backoff.

Each is a processor for ``transformWithStateInPandas``: state is declared by name and type, can be read back with the state
data source, and is given up by event-time timers. So what a stream remembers is bounded by its windows, not by the keys that
it has ever seen, and results don't depend on how rows are cut into micro-batches, nor on restarts. Rows that are older than
the watermark are dropped, as Spark does.

Every call of a processor and of its state is a message between the JVM and Python. So keys share a state by shards of their
hash: a micro-batch reads, goes through and writes a shard as a list of stretches, whose columns are arrays, and calls grow with
the shards, not with the keys or the messages. How many shards there are is part of a stream's state, as the number of its shuffle partitions is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from lodestone.streaming.changes import MAX_DELIVER, REPLAY_SECONDS, TOKEN_RPM

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The wait before the second delivery; it doubles with each one more.
BACKOFF_SECONDS = 30
#: How long ids that were given up are kept.
REMEMBER_MS = 86_400_000
#: Groups that a stream's keys are dealt to: rows and keys of one of them are a task's in a micro-batch.
SHARDS = 256
#: Keys or messages of a stretch of a shard's state.
STRETCH = 1000
#: The columns of a row's shard and of its key within that; Spark hands rows on as named tuples, whose fields don't begin with "_".
SHARD, KEY = "shard_of_key", "text_of_key"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _arrays(fields: str) -> str:
    """The columns ``fields`` as arrays."""
    return ", ".join(f"{name} array<{kind}>" for name, kind in (f.split() for f in fields.split(",")))


def _read(state: ListState) -> Iterator[tuple]:
    for stretch in state.get():
        yield from zip(*stretch)


def _stretches(rows: list[tuple]) -> list[tuple]:
    return [tuple(map(list, zip(*rows[at : at + STRETCH]))) for at in range(0, len(rows), STRETCH)]


def _put(state: ListState, rows: list[tuple]) -> None:
    if rows:
        state.put(_stretches(rows))
    else:
        state.clear()


class _Sharded(StatefulProcessor):
    """A shard's keys as one list state. Keys that have expired go whenever rows come, and all with a timer when the last has."""

    fields = ""

    def __init__(self, at: str):
        self.at = at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("state", _arrays(f"key string, {self.fields}"))
        self.timer = handle.getValueState("timer", "at long")

    def expires(self, value: tuple) -> int:
        """The time in ms from which on a key's value says nothing any more."""
        raise NotImplementedError

    def rows(self, batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(batches), ignore_index=True).sort_values(self.at, kind="stable")

    def held(self) -> dict[str | None, tuple]:
        return {key: tuple(value) for key, *value in _read(self.state)}

    def keep(self, held: dict[str | None, tuple], watermark: int) -> None:
        left = [(key, *value) for key, value in held.items() if self.expires(value) > watermark]
        timer = max((self.expires(value) for _, *value in left), default=None)
        old = self.timer.get()
        if old is not None and old[0] != timer:
            self.handle.deleteTimer(old[0])
        _put(self.state, left)
        if timer is None:
            self.timer.clear()
        elif old is None or old[0] != timer:
            self.handle.registerTimer(timer)
            self.timer.update((timer,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer = self.timer.get()
        if timer is not None and timer[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


class ReplayWindow(_Sharded):
    """Each row with ``duplicate``: a row of its id was seen at most ``seconds`` before; the later one counts from then on."""

    fields = "last long"

    def __init__(self, at: str, seconds: int):
        super().__init__(at)
        self.seconds = seconds

    def expires(self, value: tuple) -> int:
        return value[0] // 1000 + self.seconds * 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, held, out = self.rows(rows), self.held(), []
        for k, t in zip(batch[KEY].tolist(), _micros(batch[self.at])):
            last = held[k][0] if k in held else None
            out.append(last is not None and t - last <= self.seconds * 1_000_000)
            held[k] = (t if last is None else max(last, t),)
        self.keep(held, timerValues.getCurrentWatermarkInMs())
        yield batch.drop(columns=[SHARD, KEY]).assign(duplicate=out)


class TokenBucket(_Sharded):
    """Each row with ``allowed``, ``remaining`` and ``retry_after``; a bucket that is full again is forgotten."""

    fields = "tokens double, last double"

    def __init__(self, at: str, rpm: int):
        super().__init__(at)
        self.rpm = rpm

    def expires(self, value: tuple) -> int:
        tokens, last = value
        return int((last + (self.rpm - tokens) * 60 / self.rpm) * 1000) + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, held, out = self.rows(rows), self.held(), []
        for k, t in zip(batch[KEY].tolist(), _micros(batch[self.at])):
            now = t / 1_000_000
            tokens, last = held.get(k, (float(self.rpm), now))
            tokens = min(float(self.rpm), tokens + max(0.0, now - last) * self.rpm / 60)
            ok = tokens >= 1
            tokens -= ok
            held[k] = (tokens, now)
            out.append((ok, tokens, 0.0 if ok else (1 - tokens) * 60 / self.rpm))
        allowed, remaining, wait = zip(*out)
        self.keep(held, timerValues.getCurrentWatermarkInMs())
        yield batch.drop(columns=[SHARD, KEY]).assign(allowed=allowed, remaining=remaining, retry_after=wait)


class Redelivery(StatefulProcessor):
    """Deliveries of messages until one succeeds or ``max_deliver`` have failed.

    A shard's messages that wait are a list (key, id, attempt, due time and payload) with a timer for the first of them: what is
    due by the watermark comes then. Ids that were given up are a list, for whoever reads the state, for one to two days.
    """

    def __init__(self, id: str, at: str, payload: str, handle: Callable[[str, int], bool], max_deliver: int, backoff: int):
        self.id, self.at, self.payload, self.process = id, at, payload, handle
        self.max_deliver, self.backoff = max_deliver, backoff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _arrays("key string, id string, attempt int, due long, payload string"))
        self.dead = handle.getListState("dead", _arrays("key string, id string, at long"))
        self.timers = handle.getValueState("timers", "due long, forget long")

    def _held(self) -> dict[tuple, tuple]:
        return {(key, id): tuple(rest) for key, id, *rest in _read(self.waiting)}

    def _deliver(self, at: tuple, payload: str, attempt: int, now_ms: int, waiting: dict, dead: list) -> tuple:
        if self.process(payload, attempt):
            status = "delivered"
        elif attempt >= self.max_deliver:
            dead.append((*at, now_ms))
            status = "dead"
        else:
            waiting[at] = (attempt + 1, now_ms + self.backoff * 1000 * 2 ** (attempt - 1), payload)
            status = "failed"
        return *at, attempt, now_ms, status

    def _keep(self, waiting: dict, changed: bool, dead: list, fired: int | None = None) -> None:
        old = self.timers.get() or (None, None)
        due, forget = min((w[1] for w in waiting.values()), default=None), old[1]
        if changed:
            _put(self.waiting, [(*at, *w) for at, w in waiting.items()])
        if fired is not None and forget is not None and forget <= fired:
            left = [d for d in _read(self.dead) if d[2] + REMEMBER_MS > fired]
            _put(self.dead, left)
            forget = fired + REMEMBER_MS if left else None
        if dead:
            self.dead.appendList(_stretches(dead))
            forget = forget or max(d[2] for d in dead) + REMEMBER_MS
        new = (due, forget)
        if new != tuple(old):
            # A timer that both stand for is registered once; the one that fires now is deleted by Spark.
            for timer in {*old} - {*new, None}:
                if fired is None or timer > fired:
                    self.handle.deleteTimer(timer)
            for timer in {*new} - {*old, None}:
                self.handle.registerTimer(timer)
            self.timers.update(new)

    def _rows(self, found: list[tuple]) -> pd.DataFrame:
        keys, ids, attempts, at, status = zip(*found)
        return pd.DataFrame({"key": pd.Series(keys, dtype=object), "id": ids, "attempt": pd.Series(attempts, dtype="int32"), "at": pd.to_datetime(pd.Series(at), unit="ms", utc=True), "status": status})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, dead, found = self._held(), [], []
        for batch in rows:
            for k, id, payload, t in zip(batch[KEY].tolist(), batch[self.id].astype(str).tolist(), batch[self.payload].tolist(), _micros(batch[self.at])):
                if (k, id) not in waiting:  # a message that waits already is one delivery, not two
                    found.append(self._deliver((k, id), payload, 1, t // 1000, waiting, dead))
        self._keep(waiting, bool(found), dead)
        if found:
            yield self._rows(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting, dead, found = self._held(), [], []
        # What is due again before the watermark comes now too: timers set here would wait for the next one.
        while due := sorted((w[1], *at) for at, w in waiting.items() if w[1] <= now):
            for _, *at in due:
                attempt, when, payload = waiting.pop(tuple(at))
                found.append(self._deliver(tuple(at), payload, attempt, when, waiting, dead))
        self._keep(waiting, bool(found), dead, now)
        if found:
            yield self._rows(found)

    def close(self) -> None:
        pass


def _sharded(stream: DataFrame, key: str, at: str, late: str, shards: int):
    """``stream`` by shards of ``key``, which is a text in KEY. Rows without a key have a shard of their own."""
    kind, name = stream.schema[key].dataType, F.col(f"`{key}`")
    text = F.unix_micros(name).cast("string") if isinstance(kind, T.TimestampType) else F.hex(name) if isinstance(kind, T.BinaryType) else name.cast("string") if isinstance(kind, T.AtomicType) else F.to_json(name)
    shard = F.when(name.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(text), F.lit(shards))).cast("int")
    return stream.withColumn(KEY, text).withColumn(SHARD, shard).withWatermark(at, late).groupBy(SHARD)


def _unsharded(text: Column, kind: T.DataType) -> Column:
    """The key that ``text`` stands for."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("long"))
    return F.unhex(text) if isinstance(kind, T.BinaryType) else text.cast(kind) if isinstance(kind, T.AtomicType) else F.from_json(text, kind)


def _with(schema: T.StructType, *more: tuple[str, str]) -> T.StructType:
    out = T.StructType(list(schema.fields))
    for name, kind in more:
        out = out.add(name, kind)
    return out


def mark_replays(stream: DataFrame, *, id: str = "delivery_id", at: str = "at", seconds: int = REPLAY_SECONDS, late: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """``stream`` with ``duplicate``, as changes.mark_replays has it for a table. Rows without an id are left out: they repeat nothing."""
    rows = _sharded(stream.where(f"`{id}` is not null"), id, at, late, shards)
    return rows.transformWithStateInPandas(ReplayWindow(at, seconds), _with(stream.schema, ("duplicate", "boolean")), "Append", "EventTime")


def token_bucket(stream: DataFrame, *, key: str = "key", at: str = "at", rpm: int = TOKEN_RPM, late: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """``stream`` with ``allowed``, ``remaining`` and ``retry_after``, as changes.token_bucket has it for a table."""
    schema = _with(stream.schema, ("allowed", "boolean"), ("remaining", "double"), ("retry_after", "double"))
    return _sharded(stream, key, at, late, shards).transformWithStateInPandas(TokenBucket(at, rpm), schema, "Append", "EventTime")


def redeliver(stream: DataFrame, handle: Callable[[str, int], bool], *, key: str, id: str, at: str = "at", payload: str = "payload", max_deliver: int = MAX_DELIVER, backoff_seconds: int = BACKOFF_SECONDS, late: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """(key, id, attempt, at, status) of every delivery of the messages of ``stream``: delivered, failed (to come again after
    ``backoff_seconds``, twice that, and so on) or dead. ``handle(payload, attempt)`` says whether a delivery succeeds."""
    kind = stream.schema[key].dataType
    rows = _sharded(stream.select(*dict.fromkeys((key, id, at, payload))), key, at, late, shards)
    sent = rows.transformWithStateInPandas(Redelivery(id, at, payload, handle, max_deliver, backoff_seconds), "key string, id string, attempt int, at timestamp, status string", "Append", "EventTime")
    return sent.withColumn("key", _unsharded(F.col("key"), kind))


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """All of what is there, in micro-batches, to Parquet at ``out``; returns what it holds then."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
