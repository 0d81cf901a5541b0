"""Every registered operator query with SQL against DuckDB, on the smallest tables."""

import hashlib

import duckdb
import pytest

from lodestone.llm import registry

TABLES = ["documents", "embeddings", "pages", "conversations"]


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    got = registry.queries()[name](spark, sf)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    got = got.select(*names).collect()
    got, want = canonical([tuple(r) for r in got], names), canonical(want.fetchall(), names)
    assert len(got) == len(want) and hashlib.sha256("\n".join(got).encode()).digest() == hashlib.sha256("\n".join(want).encode()).digest()


def test_one_query_for_each_operator():
    assert sorted({q[2:].split("_")[0] for q in registry.queries() if q not in registry.MORE}, key=int) == [str(i) for i in range(1, 14)]
