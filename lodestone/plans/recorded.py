"""Services that answer from the test tables, as recordings would: for scans of connectors without a network."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from typing import Any

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)


def _batches(path: str, columns: list[str], where: Any = None) -> Iterator[Any]:
    import pyarrow.dataset as ds

    return ds.dataset(path, format="parquet").scanner(columns=columns, filter=where, batch_size=65_536, batch_readahead=1, fragment_readahead=1, use_threads=False).to_batches()


@lru_cache(maxsize=4)
def _sources(path: str) -> tuple[str, ...]:
    """The documents' sources in order, a batch at a time."""
    return tuple(sorted({s for b in _batches(path, ["source"]) for s in b.column(0).unique().to_pylist() if s is not None}))


class _Source:
    """A source's documents, oldest first: a document changes a minute after the one before. Two columns; rows are made a page at a time."""

    def __init__(self, path: str, name: str):
        import numpy as np
        import pyarrow as pa
        import pyarrow.dataset as ds

        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64())])
        found = (pa.RecordBatch.from_arrays([b.column(c).cast(pa.int64()) for c in schema.names], schema=schema) for b in _batches(path, schema.names, ds.field("source") == name))
        self.rows = pa.Table.from_batches(found, schema).sort_by([("doc_id", "ascending"), ("n_chars", "ascending")])
        self.seconds = self.rows.column("doc_id").to_numpy() * 60.0
        self.find = np.searchsorted

    def between(self, low: float | None, high: float | None) -> range:
        """The rows whose time of change in seconds since EPOCH is in these bounds."""
        return range(0 if low is None else int(self.find(self.seconds, low)), len(self.seconds) if high is None else int(self.find(self.seconds, high, "right")))

    def page(self, rows: range) -> list[tuple[datetime, int, int]]:
        """(time of change, doc_id, n_chars)."""
        d, n = (c.to_pylist() for c in self.rows.slice(rows.start, len(rows)).itercolumns())
        return [(EPOCH + timedelta(minutes=x), x, y) for x, y in zip(d, n)]


@lru_cache(maxsize=2)
def _source(path: str, name: str) -> _Source:
    return _Source(path, name)


def _since(at: datetime | None) -> float | None:
    return None if at is None else (at - EPOCH).total_seconds()


def _minute(query: str, op: str) -> datetime | None:
    """The bound ``op "yyyy-MM-dd HH:mm"`` of a query."""
    _, found, rest = query.partition(f'{op} "')
    return datetime.strptime(rest[:16], "%Y-%m-%d %H:%M").replace(tzinfo=UTC) if found else None


class Recorded:
    """``get`` of a wiki, an issue tracker and a chat whose spaces, projects and channels are the documents' sources. With
    ``log`` each request is a line of a file below that folder."""

    def __init__(self, sf_dir: str, log: str | None = None):
        self.path, self.log = f"{sf_dir}/documents.parquet", log

    def __call__(self, url: str, params: dict[str, Any], headers: dict[str, str]) -> dict:
        if self.log:
            import json
            import os
            import uuid

            with open(f"{self.log}/{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
                json.dump({"url": url, **params}, f)
        start = int(params.get("start") or params.get("startAt") or params.get("cursor") or 0)
        page = lambda rows, size: rows[start : start + size]
        of = lambda name, low, high: (docs := _source(self.path, name), docs.between(low, high))
        if url.endswith("/rest/api/space"):
            return {"results": [{"key": s} for s in page(_sources(self.path), params["limit"])]}
        if url.endswith("/project/search"):
            known = _sources(self.path)
            found = page(known, params["maxResults"])
            return {"values": [{"key": s} for s in found], "isLast": start + len(found) >= len(known)}
        if url.endswith("/content/search"):
            q = params["cql"]
            space, low, high = q.partition('space = "')[2].partition('"')[0], _minute(q, "lastmodified >="), _minute(q, "lastmodified <=")
            docs, rows = of(space, _since(low), _since(high))
            return {"results": [{"id": d, "title": f"{space} #{d}", "version": {"number": n, "when": t.isoformat()}, "space": {"key": space}} for t, d, n in docs.page(page(rows, params["limit"]))]}
        if url.endswith("/api/3/search"):
            q = params["jql"]
            project, low, high = q.partition("project in (")[2].partition(")")[0], _minute(q, "updated >="), _minute(q, "updated <=")
            docs, rows = of(project, _since(low), _since(high))
            return {"issues": [{"key": f"{project}-{d}", "fields": {"summary": f"{n} characters", "updated": t.isoformat()}} for t, d, n in docs.page(page(rows, params["maxResults"]))], "total": len(rows)}
        if url.endswith("conversations.history"):
            low, high = float(params["oldest"]), float(params.get("latest") or 1e12)
            docs, rows = of(params["channel"], low - EPOCH.timestamp(), high - EPOCH.timestamp())
            done = start + params["limit"]
            return {"messages": [{"ts": f"{t.timestamp():.6f}", "text": str(d), "reply_count": d % 3} for t, d, _ in docs.page(page(rows, params["limit"]))], "response_metadata": {"next_cursor": str(done) if done < len(rows) else ""}}
        raise ValueError(f"{url} isn't recorded")
