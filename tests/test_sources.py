import subprocess
from datetime import UTC, datetime

import duckdb
import pytest

from lodestone.errors import ConnectorNotFound
from lodestone.sources import REGISTRY, database, files, kubernetes, rest
from lodestone.sources.registry import Registry


def test_registry():
    assert REGISTRY.types() == ["confluence", "database", "fs", "git", "jira", "k8s", "notion", "slack"]
    with pytest.raises(ConnectorNotFound):
        REGISTRY.get("nope")
    with pytest.raises(ValueError):
        Registry().register("", object)


def test_files(spark, tmp_path):
    for name, content in {"a.py": "x", "docs/b.md": "y", "docs/deep/c.md": "z", ".git/h": "n", "docs/.hid": "n", "big.txt": "w" * 50}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    c = files.FileConnector(str(tmp_path), max_file_size_bytes=10)
    c.validate(spark)
    assert {r.external_id for r in c.discover(spark).collect()} == {"a.py", "docs/b.md", "docs/deep/c.md"}
    only = files.FileConnector(str(tmp_path), include=["docs/**"], exclude=["*/deep/*"])
    assert {r.external_id: (bytes(r.content), r.content_type) for r in only.fetch(spark).collect()} == {"docs/b.md": (b"y", "text/markdown")}
    with pytest.raises(FileNotFoundError):
        files.FileConnector(str(tmp_path / "none")).validate(spark)


def test_git(spark, tmp_path):
    from lodestone.sources.git import GitConnector

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a b.py").write_text("hi")
    (tmp_path / "bin.dat").write_bytes(b"a\0b")
    run("add", "-A")
    run("commit", "-qm", "m")
    c = GitConnector(str(tmp_path))
    c.validate(spark)
    refs = c.discover(spark)
    assert {r.external_id for r in refs.collect()} == {"a b.py", "bin.dat"}
    assert [(r.external_id, bytes(r.content)) for r in c.fetch(spark, refs).collect()] == [("a b.py", b"hi")]


def fake(pages):
    def get(url, params, headers):
        return pages(url, params)

    return get


def test_confluence(spark):
    def pages(url, p):
        if "search" in url:
            assert p["cql"] == '(type = "page") AND (space = "S")'
            n = 50 if p["start"] == 0 else 1
            return {"results": [{"id": p["start"] + i, "title": "t", "version": {"number": 2, "when": "2024-01-01T00:00:00Z"}, "metadata": {"labels": {"results": [{"name": "no"}] if i == 0 else []}}} for i in range(n)]}
        return {"title": "T", "body": {"storage": {"value": "<p>b</p>"}}}

    c = rest.Confluence({"base_url": "https://c", "space_keys": ["S"], "exclude_labels": ["no"]}, {"pat": "x"}, fake(pages))
    refs = c.discover(spark)
    assert refs.count() == 49 and refs.where("metadata['version'] = '2'").count() == 49
    assert bytes(c.fetch(spark, refs.limit(1)).first().content) == b"<h1>T</h1>\n<p>b</p>"
    with pytest.raises(ValueError):
        rest.Confluence({}, {})


def test_notion_slack_jira(spark):
    notion = rest.Notion({"database_ids": ["d"]}, {"api_key": "k"}, fake(lambda u, p: {"results": [{"id": "p1", "last_edited_time": "2024-01-01T00:00:00Z", "properties": {"N": {"type": "title", "title": [{"plain_text": "x"}]}}}], "has_more": False} if "query" in u else {"results": [{"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": "hey"}]}}]}))
    refs = notion.discover(spark)
    assert refs.first().metadata["property.N"] == "x" and bytes(notion.fetch(spark, refs).first().content) == b"hey"
    now = datetime(2024, 1, 8, tzinfo=UTC)

    def slack(u, p):
        if "history" in u:
            assert float(p["oldest"]) == now.timestamp() - 90 * 86400
            return {"messages": [{"ts": "1704600000.1", "text": "r"}, {"ts": "1704600001.1", "subtype": "join"}]}
        return {"messages": [{"ts": "1704600000.1", "text": "root", "user": "u"}, {"ts": "1704600060.1", "text": "re", "user": "v"}]}

    s = rest.Slack({"channels": ["C"]}, {"bot_token": "t"}, fake(slack), lambda: now)
    refs = s.discover(spark)
    assert [r.external_id for r in refs.collect()] == ["C:1704600000.1"]
    assert bytes(s.fetch(spark, refs).first().content).decode() == "**u** (2024-01-07 04:00 UTC)\nroot\n\n**v** (2024-01-07 04:01 UTC)\nre"
    issue = {"key": "K-1", "fields": {"summary": "S", "updated": "2024-01-01T00:00:00.000+0000", "status": {"name": "Open"}, "comment": {"comments": [{"author": {"displayName": "A"}, "created": "c", "body": "text"}]}}}
    j = rest.Jira({"project_keys": ["K"]}, {"email": "e", "api_token": "t"}, fake(lambda u, p: {"issues": [issue], "total": 1} if "search" in u else issue))
    assert j.jql() == "project in (K) ORDER BY updated DESC"
    assert bytes(j.fetch(spark, j.discover(spark)).first().content).decode() == "# K-1: S\n\n**Status**: Open\n\n## Comments\n\n**A** (c)\n\ntext"


def test_database(spark):
    con = duckdb.connect()
    con.execute("create table main.t (id integer primary key, v decimal(8, 2) default 1.5, name varchar unique)")

    def read(query):
        t = con.execute(query.replace("c.*, cast(null as varchar) as comment", "table_schema, table_name, column_name, ordinal_position, data_type, data_type as udt_name, is_nullable, column_default, cast(null as integer) as character_maximum_length, cast(null as integer) as numeric_precision, cast(null as integer) as numeric_scale, cast(null as varchar) as comment")) if "columns c" in query else con.execute(query) if "constraint" not in query else None
        if t is None:
            rows = [("main", "t", "PRIMARY KEY", "pk", "id", None, None, None, 1), ("main", "t", "FOREIGN KEY", "fk", "v", "o", "x", None, 1)]
            return spark.createDataFrame(rows, "table_schema string, table_name string, constraint_type string, constraint_name string, column_name string, foreign_table_name string, foreign_column_name string, check_clause string, ordinal int")
        kinds = {"ordinal_position": "int", "character_maximum_length": "int", "numeric_precision": "int", "numeric_scale": "int"}
        rows, names = t.fetchall(), [d[0] for d in t.description]
        return spark.createDataFrame(rows, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))

    c = database.DatabaseConnector(read, schemas=["main"])
    assert c.discover(spark).first().uri == "db://main/t"
    text = bytes(c.fetch(spark).first().content).decode()
    assert "- **Primary Key**: `id`\n- **Foreign Key** (`fk`): `v` → `o`.`x`" in text and "`t`.`v` references `o`.`x`" in text and "| `id` | `INTEGER` | NO |" in text


def test_kubernetes(spark):
    assert kubernetes.parse_kinds('```json\n["Pod"]\n```') == ["Pod"] and kubernetes.parse_kinds("no") == []
    assert kubernetes.select_kinds(["Pod", "Secret", "Job"], ["Job"]) == ["Pod"]
    assert kubernetes.api_path("Deployment", "n") == "/apis/apps/v1/namespaces/n/deployments" and kubernetes.api_path("Namespace", "n") == "/api/v1/namespaces"
    tries = iter(["bad", '["x"]'])
    assert kubernetes.discover_with(lambda p: next(tries), "p", kubernetes.parse_kinds, list) == ["x"]
    c = kubernetes.KubernetesConnector({"base_url": "https://b", "kinds": ["Pod"], "namespaces": ["n"]}, {"token": "t"}, fake(lambda u, p: {"items": [{"metadata": {"name": "a", "namespace": "n"}}]}))
    assert c.discover(spark).first().external_id == "Pod/n/a"


def test_kubernetes_pages_and_fetch(spark):
    def api(u, p):
        if u.endswith("/pods"):
            return {"items": [{"metadata": {"name": "a", "namespace": "n"}}], "metadata": {"continue": "t"}} if "continue" not in p else {"items": [{"metadata": {"name": "b", "namespace": "n"}}]}
        return {} if u.endswith("/b") else {"metadata": {"name": "a", "namespace": "n", "managedFields": [1], "annotations": {"kubectl.kubernetes.io/last-applied-configuration": "{}"}}, "spec": {"x": 1}}

    c = kubernetes.KubernetesConnector({"base_url": "https://b", "kinds": ["Pod"], "namespaces": ["n"]}, {"token": "t"}, fake(api))
    refs = c.discover(spark)
    assert sorted(r.external_id for r in refs.collect()) == ["Pod/n/a", "Pod/n/b"]
    got = c.fetch(spark, refs).collect()
    assert [(r.external_id, bytes(r.content).decode()) for r in got] == [("Pod/n/a", "kind: Pod\nmetadata:\n  annotations: {}\n  name: a\n  namespace: n\nspec:\n  x: 1\n")]


@pytest.mark.parametrize("config", [{"base_url": "ftp://x"}, {"channels": "C"}, {"channels": [1]}, {"max_age_days": 0}, {"max_age_days": "9"}])
def test_configurations_are_checked(config):
    from lodestone.errors import ConfigError

    with pytest.raises(ConfigError):
        rest.Slack(config, {"bot_token": "t"}, fake(lambda u, p: {}))
