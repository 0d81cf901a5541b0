"""Connectors as Spark data sources: listings run in partitions on the executors, as batches and as streams.

A connector that can be scanned has ``slices()``, the parts that can be listed apart (a space, a project, a channel, a kind in
a namespace, a part of a tree), and ``listed(slice, since, until)``, the refs of one part that changed in that time, page by
page. A partition of the scan is a slice. Filters on ``slice`` choose partitions and filters on ``updated_at`` go into the
requests, so that a service is asked for what is wanted only. The offset of a stream is a time: each batch lists what changed
after the last one's, up to its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "external_id string, uri string, slice string, updated_at timestamp, metadata map<string,string>"
#: Refs of an Arrow batch.
BATCH = 1000
_ARROW = pa.schema([("external_id", pa.string()), ("uri", pa.string()), ("slice", pa.string()), ("updated_at", pa.timestamp("us", "UTC")), ("metadata", pa.map_(pa.string(), pa.string()))])


def aware(t: datetime | None) -> datetime | None:
    """``t`` in UTC; a time without a zone is meant to be."""
    return None if t is None else t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)


class Slice(InputPartition):
    def __init__(self, name: str | None, since: datetime | None = None, until: datetime | None = None, after: datetime | None = None):
        self.name, self.since, self.until, self.after = name, since, until, after


def rows(connector: Any, part: Slice) -> Iterator[pa.RecordBatch]:
    """The refs of a slice in Arrow batches; services that know minutes only may give more than was asked for. With ``after``
    (a stream's last offset) what changed then or before is left out, and what has no time of change too."""
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        ids, uris, at, meta = zip(*held)
        columns = [ids, uris, [part.name] * len(ids), at, [list(m.items()) for m in meta]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    for ref in connector.listed(part.name, part.since, part.until):
        t = aware(ref.updated_at)
        if part.since and (t is None or t < part.since) or part.until and (t is None or t > part.until) or part.after and (t is None or t <= part.after):
            continue
        external_id, uri, _, meta = ref.row()
        held.append((external_id, uri, t, meta))
        if len(held) == BATCH:
            yield out()
            held.clear()
    if held:
        yield out()


class Reader(DataSourceReader):
    def __init__(self, connector: Any):
        self.connector, self.wanted, self.since, self.until = connector, None, None, None

    def pushFilters(self, filters: list[Filter]):
        """Takes equality and lists on ``slice`` and bounds on ``updated_at``. Spark keeps exclusive bounds besides, as requests
        take inclusive ones."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("slice",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("updated_at",):
                self.since = max(filter(None, (self.since, aware(f.value))))
                if isinstance(f, GreaterThan):
                    yield f
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("updated_at",):
                self.until = min(filter(None, (self.until, aware(f.value))))
                if isinstance(f, LessThan):
                    yield f
            else:
                yield f

    def partitions(self) -> list[Slice]:
        found = [Slice(n, self.since, self.until) for n in self.connector.slices() if self.wanted is None or n in self.wanted]
        return found or [Slice(None)]  # Spark has no scan without partitions: one that lists nothing

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition.name is None else rows(self.connector, partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are times, as JSON: what changed after the start, up to the end."""

    def __init__(self, connector: Any, begin: datetime | None = None):
        self.connector, self.begin = connector, begin

    def initialOffset(self) -> dict:
        return {"upto": self.begin.isoformat() if self.begin else None}

    def latestOffset(self) -> dict:
        return {"upto": aware(self.connector.now()).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        time = lambda offset: datetime.fromisoformat(offset["upto"]) if offset["upto"] else None
        return [Slice(n, time(start), time(end), time(start)) for n in self.connector.slices()]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return rows(self.connector, partition)


def source_class(connector: Any, name: str) -> type[DataSource]:
    """A data source of one configured connector, which goes to the executors with it."""

    class Connected(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader(connector)

        def streamReader(self, schema) -> StreamReader:
            begin = self.options.get("since")
            return StreamReader(connector, aware(datetime.fromisoformat(begin)) if begin else None)

    return Connected


class Lodestone(DataSource):
    """``spark.read.format("lodestone")`` with the options ``connector`` (a registered type), ``config`` and ``secrets`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "lodestone"

    def schema(self) -> str:
        return SCHEMA

    def connector(self) -> Any:
        from lodestone.sources import REGISTRY

        made = REGISTRY.get(self.options.get("connector", ""))
        return made(json.loads(self.options.get("config", "{}")), json.loads(self.options.get("secrets", "{}")))

    def reader(self, schema) -> Reader:
        return Reader(self.connector())

    def streamReader(self, schema) -> StreamReader:
        begin = self.options.get("since")
        return StreamReader(self.connector(), aware(datetime.fromisoformat(begin)) if begin else None)


def register(spark: SparkSession, connector: Any = None) -> str:
    """Makes ``spark.read.format(name)`` and ``spark.readStream.format(name)`` list ``connector``; returns the name. Without
    one it is the general source, ``lodestone``. Filters of scans are pushed from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    name = "lodestone" if connector is None else f"lodestone_{type(connector).__name__.lower()}_{uuid.uuid4().hex[:12]}"
    spark.dataSource.register(Lodestone if connector is None else source_class(connector, name))
    return name


def read(spark: SparkSession, connector: Any) -> DataFrame:
    """All refs of ``connector`` (SCHEMA), listed by the executors."""
    return spark.read.format(register(spark, connector)).load()


def read_stream(spark: SparkSession, connector: Any, since: datetime | None = None) -> DataFrame:
    """Refs of ``connector`` as they change, from ``since`` on (else from the beginning)."""
    source = spark.readStream.format(register(spark, connector))
    return (source.option("since", aware(since).isoformat()) if since else source).load()
