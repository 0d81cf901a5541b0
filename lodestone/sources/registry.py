"""Connector types by name."""

from __future__ import annotations

import logging
import mimetypes
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from lodestone.errors import ConnectorNotFound

log = logging.getLogger(__name__)
REF = "external_id string, uri string, updated_at timestamp, metadata map<string,string>"
DOCUMENT = REF + ", content_type string, content binary"


@dataclass
class Ref:
    external_id: str
    uri: str
    updated_at: datetime | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def row(self) -> tuple:
        return self.external_id, self.uri, self.updated_at, {k: str(v) for k, v in self.metadata.items() if v is not None}


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Any] = {}

    def register(self, kind: str, connector: Any) -> None:
        if not kind:
            raise ValueError("a connector needs a type")
        if kind in self._known:
            log.warning("connector %s is replaced", kind)
        self._known[kind] = connector

    def get(self, kind: str) -> Any:
        if kind not in self._known:
            raise ConnectorNotFound(f"no connector {kind!r}", known=self.types())
        return self._known[kind]

    def types(self) -> list[str]:
        return sorted(self._known)


def content_type(path):
    """The MIME type of a path column, by its extension, in the JVM; ``text/plain`` where it isn't known."""
    from pyspark.sql import functions as F

    mimetypes.init()
    known = {k: v for k, v in sorted(mimetypes.types_map.items()) if k.isascii()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    hidden = F.regexp_extract(path, r"([^/]*)$", 1).rlike(r"^\.[^.]*$")
    return F.when(hidden, F.lit("text/plain")).otherwise(F.coalesce(F.try_element_at(table, extension), F.lit("text/plain")))


def guess_type(path: str) -> str:
    return mimetypes.guess_type(path)[0] or "text/plain"
