"""Predicates of search and listing, as column expressions that Catalyst can push into scans."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(column: str, values: Sequence[str] | None) -> Column | None:
    """Equality with any of ``values``; no or an empty list is no filter."""
    return F.col(column).isin(*values) if values else None


def fresh(column: str, max_age_seconds: int | None, now: datetime) -> Column | None:
    """At most ``max_age_seconds`` before ``now``, inclusive."""
    if max_age_seconds is None:
        return None
    return F.col(column) >= F.lit(now) - F.make_dt_interval(secs=F.lit(max_age_seconds))


def live(column: str = "tombstoned_at", include_tombstoned: bool = False) -> Column | None:
    return None if include_tombstoned else F.col(column).isNull()


def _contains(value: Column, want: Any) -> Column:
    """Containment in a variant: objects by member, arrays as sets, scalars by value."""
    if isinstance(want, Mapping):
        members = F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
        tests = [_contains(F.try_element_at(members, F.lit(k)), v) for k, v in want.items()]  # not by a path: keys may hold quotes
        return reduce(lambda a, b: a & b, tests, F.schema_of_variant(value).startswith("OBJECT"))
    if isinstance(want, list):
        have = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))

        def member(w: Any) -> Column:
            return F.exists(have, lambda x: F.coalesce(_contains(x, w), F.lit(False)))

        tests = [member(w) for w in want]
        return reduce(lambda a, b: a & b, tests, F.schema_of_variant(value).startswith("ARRAY"))
    return F.to_json(value) == F.lit(json.dumps(want, ensure_ascii=False))


def metadata_contains(column: str, want: Mapping[str, Any] | None, *, nested: bool = False) -> Column | None:
    """Every given key and value is contained. Flat maps compare strings; ``nested`` reads the column as JSON."""
    if not want:
        return None
    if nested:
        return F.coalesce(_contains(F.try_parse_json(F.col(column)), want), F.lit(False))
    return reduce(lambda a, b: a & b, [F.coalesce(F.try_element_at(F.col(column), F.lit(k)) == F.lit(str(v)), F.lit(False)) for k, v in want.items()])


def conjunction(*clauses: Column | None) -> Column | None:
    """All given clauses, in order; None without any."""
    given = [c for c in clauses if c is not None]
    return reduce(lambda a, b: a & b, given) if given else None


def apply(df: DataFrame, *clauses: Column | None) -> DataFrame:
    both = conjunction(*clauses)
    return df if both is None else df.where(both)


def workspace(df: DataFrame, workspace_id: str | None) -> DataFrame:
    """Rows of a workspace and those without one, by ``workspace_id`` or else ``tenant_id``; all if neither is there."""
    column = next((c for c in ("workspace_id", "tenant_id") if c in df.columns), None)
    if workspace_id is None or column is None:
        return df
    return df.where((F.col(column) == workspace_id) | F.col(column).isNull())


#: What a scope implies besides itself. Fixed values.
IMPLIED = {"admin": ["admin", "search", "sources:read", "sources:write"]}


def has_scopes(granted: Column, required: Sequence[str]) -> Column:
    """All ``required`` are granted; admin implies all of them."""
    every = F.when(F.array_contains(granted, "admin"), F.array_union(granted, F.array(*map(F.lit, [*IMPLIED["admin"], *required])))).otherwise(granted)
    return F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), every)) == 0


#: What an access token starts with, and how much of it is stored in the clear to find its row.
TOKEN_PREFIX, SHOWN = "lds_", 12


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def issue_token(name: str, scopes: Sequence[str], *, workspace_id: str | None = None, expires_at: datetime | None = None) -> tuple[str, dict[str, Any]]:
    """(the token, its row): only the start and the hash are stored."""
    import hashlib
    import secrets
    import uuid

    token = TOKEN_PREFIX + secrets.token_urlsafe(32)
    row = {"id": str(uuid.uuid4()), "name": name, "prefix": token[:SHOWN], "hash": hashlib.sha256(token.encode()).hexdigest(), "scopes": list(scopes), "workspace_id": workspace_id, "expires_at": expires_at, "is_active": True}
    return token, row


def revoke_tokens(tokens: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Soft deletion: the rows stay, inactive."""
    return tokens.withColumn("is_active", F.col("is_active") & ~F.col("id").isin(*ids)) if ids else tokens


def authenticate(presented: DataFrame, tokens: DataFrame, now: datetime, required: Sequence[str] = ()) -> DataFrame:
    """``presented`` (token, ...) with token_id and status: ok, forbidden (a scope is missing) or unauthorized. Rows meet on
    the stored start, then the hash decides."""
    known = valid_tokens(tokens, now).select(F.col("id").alias("token_id"), F.col("prefix").alias("__prefix"), F.col("hash").alias("__hash"), "scopes")
    found = presented.join(known, (F.substring("token", 1, SHOWN) == F.col("__prefix")) & (token_hash(F.col("token")) == F.col("__hash")), "left")
    enough = has_scopes(F.col("scopes"), required) if required else F.lit(True)
    status = F.when(F.col("token_id").isNull(), "unauthorized").when(enough, "ok").otherwise("forbidden")
    return found.select(*presented.columns, "token_id", status.alias("status"))


def valid_tokens(tokens: DataFrame, now: datetime) -> DataFrame:
    return tokens.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))))


def allow_then_deny(column: str, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> Column:
    """In ``allow`` (empty: all) and not in ``deny``."""
    inside = F.col(column).isin(*allow) if allow else F.lit(True)
    return inside & ~F.col(column).isin(*deny) if deny else inside
