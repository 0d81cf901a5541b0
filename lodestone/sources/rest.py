"""Paged REST sources. A connector takes ``get(url, params, headers) -> dict``; the default uses the standard library.

Pages of one listing depend on each other, so a source is listed slice by slice: a space, a database, a channel (or some days
of it), a project. Slices are the partitions of a scan (see ``scan``); fetching is spread over refs.
"""

from __future__ import annotations

import base64
import json
import urllib.parse
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import ConfigError, Unauthorized
from lodestone.parsers.markup import adf, notion_blocks, notion_property
from lodestone.sources import scan
from lodestone.sources.registry import Ref

Get = Callable[[str, dict[str, Any], dict[str, str]], dict]
PAGE = 50


def http_get(url: str, params: dict[str, Any], headers: dict[str, str]) -> dict:
    import urllib.error
    import urllib.parse
    import urllib.request

    query = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
    try:
        with urllib.request.urlopen(urllib.request.Request(f"{url}?{query}" if query else url, headers=headers), timeout=30) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code == 401:
            raise Unauthorized(f"credentials were refused by {url}") from e
        raise


def parse_time(value: str | None) -> datetime | None:
    if not value:
        return None
    try:
        return datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return None


def minute(t: datetime, up: bool) -> str:
    """``t`` as query languages take it, to the minute: the one before, or with ``up`` the one after."""
    t = scan.aware(t)
    return (t + timedelta(seconds=59, microseconds=999_999) if up else t).strftime("%Y-%m-%d %H:%M")


def bearer(secrets: dict[str, str], name: str) -> dict[str, str]:
    if not secrets.get(name):
        raise ValueError(f"secret {name!r} is missing")
    return {"Authorization": f"Bearer {secrets[name]}"}


def basic_or_pat(secrets: dict[str, str]) -> dict[str, str]:
    if secrets.get("pat"):
        return bearer(secrets, "pat")
    if not secrets.get("email") or not secrets.get("api_token"):
        raise ValueError("either pat, or email and api_token are needed")
    return {"Authorization": "Basic " + base64.b64encode(f"{secrets['email']}:{secrets['api_token']}".encode()).decode()}


def checked(config: dict[str, Any] | None, fields: dict[str, type]) -> dict[str, Any]:
    """``config`` if its values have the types of ``fields``: lists are of strings, numbers at least 1, addresses HTTP ones."""
    config = dict(config or {})
    for name, kind in fields.items():
        value = config.get(name)
        if value is None:
            continue
        fits = isinstance(value, list | tuple) and all(isinstance(x, str) and x for x in value) if kind is list else isinstance(value, kind) and not isinstance(value, bool)
        if not fits or kind is int and value < 1 or name == "base_url" and urllib.parse.urlsplit(value).scheme not in ("http", "https"):
            raise ConfigError(f"{name} is no valid {'list of texts' if kind is list else kind.__name__}", field=name)
    return config


class RestConnector:
    """Subclasses list refs and render one document."""

    probe = ""
    #: The configuration's fields and their types.
    fields: dict[str, type] = {"base_url": str}

    def __init__(self, config: dict[str, Any] | None = None, secrets: dict[str, str] | None = None, get: Get = http_get, now: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.config = checked(config, {"base_url": str, **self.fields})
        self.base, self.get, self.now = (self.config.get("base_url") or "").rstrip("/"), get, now
        self.headers = self.credentials(secrets or {})

    def credentials(self, secrets: dict[str, str]) -> dict[str, str]:
        return basic_or_pat(secrets)

    def call(self, path: str, **params: Any) -> dict:
        return self.get(self.base + path, params, self.headers)

    def validate(self, spark: SparkSession) -> None:
        """The cheapest call that needs credentials."""
        self.call(self.probe)

    def slices(self) -> list[str]:
        """Parts that are listed apart; '' is all there is."""
        return [""]

    def listed(self, slice: str, since: datetime | None = None, until: datetime | None = None) -> Iterator[Ref]:
        """Refs of a slice, page by page: at least those that changed from ``since`` to ``until``."""
        raise NotImplementedError

    def render(self, external_id: str, metadata: dict[str, str]) -> str:
        raise NotImplementedError

    def discover(self, spark: SparkSession) -> DataFrame:
        """All refs (REF), listed by the executors."""
        return scan.read(spark, self).drop("slice")

    def fetch(self, spark: SparkSession, refs: DataFrame) -> DataFrame:
        me = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                text = [me.render(i, dict(m or {})) for i, m in zip(batch.external_id, batch.metadata)]
                yield pd.DataFrame({"external_id": batch.external_id, "uri": batch.uri, "content_type": "text/markdown", "content": [t.encode() for t in text]})

        return refs.mapInPandas(run, "external_id string, uri string, content_type string, content binary")


class Confluence(RestConnector):
    """Pages and blog posts by space and label; bodies stay storage format, which convert.storage_to_markdown rewrites."""

    probe = "/rest/api/space"
    fields = {"content_types": list, "space_keys": list, "include_labels": list, "exclude_labels": list}

    def slices(self) -> list[str]:
        """The configured spaces, else all that the service lists."""
        if self.config.get("space_keys"):
            return list(self.config["space_keys"])
        keys: list[str] = []
        while True:
            found = self.call("/rest/api/space", start=len(keys), limit=PAGE).get("results") or []
            keys += [str(s["key"]) for s in found]
            if len(found) < PAGE:
                return keys or [""]

    def cql(self, space: str = "", since: datetime | None = None, until: datetime | None = None) -> str:
        def any_of(field: str, values: list[str]) -> str:
            return "(" + " OR ".join(f'{field} = "{v}"' for v in values) + ")"

        parts = [any_of("type", self.config.get("content_types") or ["page"])]
        parts += [any_of("space", [space])] if space else []
        parts += [any_of("label", self.config["include_labels"])] if self.config.get("include_labels") else []
        parts += [f'lastmodified {op} "{minute(t, up)}"' for op, t, up in ((">=", since, False), ("<=", until, True)) if t]
        return " AND ".join(parts)

    def listed(self, slice: str, since: datetime | None = None, until: datetime | None = None) -> Iterator[Ref]:
        start, hidden, cql = 0, set(self.config.get("exclude_labels") or ()), self.cql(slice, since, until)
        while True:
            page = self.call("/rest/api/content/search", cql=cql, start=start, limit=PAGE, expand="version,space,metadata.labels")
            found = page.get("results") or []
            for c in found:
                labels = {x.get("name") for x in ((c.get("metadata") or {}).get("labels") or {}).get("results") or []}
                if not labels & hidden:
                    version = c.get("version") or {}
                    yield Ref(str(c["id"]), f"{self.base}/pages/{c['id']}", parse_time(version.get("when")), {"version": version.get("number"), "title": c.get("title"), "space": (c.get("space") or {}).get("key"), "labels": ",".join(sorted(labels - {None}))})
            if len(found) < PAGE:
                return
            start += PAGE

    def render(self, external_id: str, metadata: dict[str, str]) -> str:
        c = self.call(f"/rest/api/content/{external_id}", expand="body.storage")
        return f"<h1>{c.get('title', '')}</h1>\n" + ((c.get("body") or {}).get("storage") or {}).get("value", "")


class Notion(RestConnector):
    probe = "/v1/users/me"
    fields = {"database_ids": list, "page_ids": list}

    def credentials(self, secrets: dict[str, str]) -> dict[str, str]:
        return bearer(secrets, "api_key") | {"Notion-Version": "2022-06-28"}

    def _pages(self, path: str, **params: Any) -> Iterator[dict]:
        cursor = None
        while True:
            page = self.call(path, start_cursor=cursor, page_size=PAGE, **params)
            yield from page.get("results") or []
            cursor = page.get("next_cursor")
            if not page.get("has_more") or not cursor:
                return

    def slices(self) -> list[str]:
        """Databases, single pages, or else all that search gives."""
        return [f"database:{d}" for d in self.config.get("database_ids") or ()] or [f"page:{p}" for p in self.config.get("page_ids") or ()] or [""]

    def listed(self, slice: str, since: datetime | None = None, until: datetime | None = None) -> Iterator[Ref]:
        kind, _, name = slice.partition(":")
        edited = [{"timestamp": "last_edited_time", "last_edited_time": {op: t.isoformat()}} for op, t in (("on_or_after", since), ("on_or_before", until)) if t]
        if kind == "database":
            found = self._pages(f"/v1/databases/{name}/query", **({"filter": json.dumps({"and": edited})} if edited else {}))
        else:
            found = iter([self.call(f"/v1/pages/{name}")]) if kind == "page" else self._pages("/v1/search", filter="page")
        for p in found:
            typed = {k: v for k, raw in (p.get("properties") or {}).items() if (v := notion_property(raw)) not in (None, "")}
            yield Ref(p["id"], p.get("url", ""), parse_time(p.get("last_edited_time")), {"version": p.get("last_edited_time"), **{f"property.{k}": ",".join(map(str, v)) if isinstance(v, list) else v for k, v in typed.items()}})

    def _blocks(self, block: str) -> list[dict]:
        out = list(self._pages(f"/v1/blocks/{block}/children"))
        for b in out:
            if b.get("has_children"):
                b["children"] = self._blocks(b["id"])
        return out

    def render(self, external_id: str, metadata: dict[str, str]) -> str:
        return notion_blocks(self._blocks(external_id))


class Slack(RestConnector):
    """Threads of channels, newer than ``max_age_days``."""

    probe = "/api/auth.test"
    fields = {"channels": list, "max_age_days": int, "slice_days": int}

    def credentials(self, secrets: dict[str, str]) -> dict[str, str]:
        return bearer(secrets, "bot_token")

    def _messages(self, path: str, **params: Any) -> Iterator[dict]:
        cursor = None
        while True:
            page = self.call(path, cursor=cursor, limit=PAGE, **params)
            yield from page.get("messages") or []
            cursor = (page.get("response_metadata") or {}).get("next_cursor")
            if not cursor:
                return

    def slices(self) -> list[str]:
        """Channels, cut into stretches of ``slice_days`` if that is set: ``C``, or ``C/k`` for the k-th stretch."""
        count = -(-self.config.get("max_age_days", 90) // self.config["slice_days"]) if self.config.get("slice_days") else 0
        return [f"{c}/{k}" if count else c for c in self.config.get("channels") or () for k in range(count or 1)]

    def listed(self, slice: str, since: datetime | None = None, until: datetime | None = None) -> Iterator[Ref]:
        channel, _, k = slice.partition("/")
        oldest, latest = self.now() - timedelta(days=self.config.get("max_age_days", 90)), until
        if k:
            first = oldest + timedelta(days=int(k) * self.config["slice_days"])
            last = first + timedelta(days=self.config["slice_days"], microseconds=-1)
            oldest, latest = first, min(last, until) if until else last
        oldest = max(oldest, since) if since else oldest
        if latest is None or oldest <= latest:
            bound = {"latest": f"{latest.timestamp():.6f}"} if latest else {}
            for m in self._messages("/api/conversations.history", channel=channel, oldest=f"{oldest.timestamp():.6f}", inclusive="true", **bound):
                if not m.get("subtype"):
                    yield Ref(f"{channel}:{m['ts']}", f"slack://{channel}/{m['ts']}", datetime.fromtimestamp(float(m["ts"]), UTC), {"channel": channel, "ts": m["ts"], "replies": m.get("reply_count", 0)})

    def render(self, external_id: str, metadata: dict[str, str]) -> str:
        """The root and its replies."""
        channel, _, ts = external_id.partition(":")
        out = []
        for m in self._messages("/api/conversations.replies", channel=channel, ts=ts):
            at = datetime.fromtimestamp(float(m["ts"]), UTC).strftime("%Y-%m-%d %H:%M")
            lines = [f"**{m.get('user', 'unknown')}** ({at} UTC)", m.get("text", ""), *(a.get("text") or a.get("fallback") or "" for a in m.get("attachments") or [])]
            out.append("\n".join(x for x in lines if x.strip()))
        return "\n\n".join(out)


def field_text(value: Any) -> str:
    """A Jira field as text: an object's display name, name, value or key; lists joined by commas."""
    if isinstance(value, dict):
        return next((str(value[k]) for k in ("displayName", "name", "value", "key") if value.get(k)), "")
    return ", ".join(filter(None, map(field_text, value))) if isinstance(value, list) else "" if value is None else str(value)


class Jira(RestConnector):
    probe = "/rest/api/3/myself"
    fields = {"project_keys": list, "issue_types": list, "jql": str}

    def slices(self) -> list[str]:
        """The configured projects, else all that the service lists."""
        if self.config.get("project_keys"):
            return list(self.config["project_keys"])
        keys: list[str] = []
        while True:
            page = self.call("/rest/api/3/project/search", startAt=len(keys), maxResults=PAGE)
            found = page.get("values") or []
            keys += [p["key"] for p in found]
            if not found or page.get("isLast", True):
                return keys or [""]

    def jql(self, project: str = "", since: datetime | None = None, until: datetime | None = None) -> str:
        projects = [project] if project else self.config.get("project_keys")
        parts = [f"project in ({', '.join(projects)})"] if projects else []
        parts += [f"issuetype in ({', '.join(json.dumps(t) for t in self.config['issue_types'])})"] if self.config.get("issue_types") else []
        parts += [f"({self.config['jql']})"] if self.config.get("jql") else []
        parts += [f'updated {op} "{minute(t, up)}"' for op, t, up in ((">=", since, False), ("<=", until, True)) if t]
        return (" AND ".join(parts) + " " if parts else "") + "ORDER BY updated DESC"

    def listed(self, slice: str, since: datetime | None = None, until: datetime | None = None) -> Iterator[Ref]:
        start, jql = 0, self.jql(slice, since, until)
        while True:
            page = self.call("/rest/api/3/search", jql=jql, startAt=start, maxResults=PAGE, fields="summary,updated,status,assignee,labels")
            found = page.get("issues") or []
            for i in found:
                f = i.get("fields") or {}
                yield Ref(i["key"], f"{self.base}/browse/{i['key']}", parse_time(f.get("updated")), {"version": f.get("updated"), "title": f.get("summary"), "status": field_text(f.get("status")), "assignee": field_text(f.get("assignee")), "labels": field_text(f.get("labels"))})
            start += len(found)
            if not found or start >= page.get("total", 0):
                return

    def render(self, external_id: str, metadata: dict[str, str]) -> str:
        f = self.call(f"/rest/api/3/issue/{external_id}", fields="*all").get("fields") or {}

        def rich(value: Any) -> str:
            return adf(value).strip() if isinstance(value, dict | list) else field_text(value)

        parts = [f"# {external_id}: {field_text(f.get('summary'))}", *(f"**{k.title()}**: {v}" for k in ("status", "priority", "assignee", "reporter") if (v := field_text(f.get(k)))), rich(f.get("description"))]
        notes = (f.get("comment") or {}).get("comments") or []
        parts += ["## Comments"] * bool(notes) + [f"**{field_text(c.get('author'))}** ({c.get('created', '')})\n\n{rich(c.get('body'))}" for c in notes]
        return "\n\n".join(p for p in parts if p)
