"""Typed errors with stable codes, and the envelope that services return."""

from __future__ import annotations

from typing import Any


class EngineError(Exception):
    code = "internal"

    def __init__(self, message: str, **details: Any):
        super().__init__(message)
        self.message, self.details = message, details

    def envelope(self) -> dict[str, Any]:
        return {"error": {"code": self.code, "message": self.message, "details": self.details}}


class InvalidRequest(EngineError):
    code = "invalid_request"


class SourceNotFound(EngineError):
    code = "source_not_found"


class DocumentNotFound(EngineError):
    code = "document_not_found"


class ConnectorNotFound(EngineError):
    code = "connector_not_found"


class Unauthorized(EngineError):
    code = "unauthorized"


class Forbidden(EngineError):
    code = "forbidden"


class RateLimited(EngineError):
    code = "rate_limited"


class ConfigError(EngineError):
    code = "config_error"


class Conflict(EngineError):
    code = "conflict"
