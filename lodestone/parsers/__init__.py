"""Parsers: a document's content to titled sections, and sections to graph entities and edges.

Parsing needs real grammars, so it runs in Python over Arrow batches; everything after it is relational.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.parsers import code, infra, markup

#: Extensions and content types by parser (fixed values).
TERRAFORM_TYPES = ["application/x-terraform", "text/x-terraform", "application/hcl"]
KUBERNETES_TYPES = ["application/x-kubernetes", "text/x-kubernetes"]
MARKDOWN_TYPES = ["text/markdown", "text/x-markdown"]


def choose(content_type: str, path: str) -> str:
    """The first parser that claims the document; plain text takes the rest."""
    name = path.lower()
    extension = name[name.rfind(".") :] if "." in name else ""
    if content_type in TERRAFORM_TYPES or extension == ".tf" or name.endswith(".tf.json"):
        return "terraform"
    if content_type in KUBERNETES_TYPES or extension in (".yaml", ".yml"):
        return "kubernetes"
    if content_type in MARKDOWN_TYPES or extension in (".md", ".markdown", ".mdx"):
        return "markdown"
    return "code" if extension in code.LANGUAGES else "plaintext"


def parse(content: bytes, content_type: str = "", path: str = "") -> dict:
    """title, sections, metadata, content_type and language of one document."""
    text = content.decode("utf-8", errors="replace").removeprefix("﻿")
    kind = choose(content_type, path)
    if kind == "terraform":
        return infra.terraform_json(text) if path.endswith(".json") else infra.terraform(text)
    if kind == "kubernetes":
        return infra.kubernetes(text) or markup.plaintext(text)
    if kind == "markdown":
        return markup.markdown(text)
    return (code.parse(text, path) if kind == "code" else None) or markup.plaintext(text)


#: Documents that Python holds at once with all that is made of them.
HELD = 200


def _some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """HELD documents of a batch at a time, so that memory doesn't grow with the rows that Spark puts in a batch."""
    for batch in batches:
        for at in range(0, len(batch), HELD):
            yield batch.iloc[at : at + HELD]


_SECTION = "struct<heading_path:array<string>,text:string,line_start:int,line_end:int,symbol:string,metadata:map<string,string>>"


def parse_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (id, path, content_type, content) with title, language, doc_metadata and sections; content goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _some(batches):
            rows = []
            for r in batch.itertuples():
                d = parse(bytes(r.content or b""), r.content_type or "", r.path or "")
                flat = [{**s, "metadata": {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in s["metadata"].items()}} for s in d["sections"]]
                rows.append((r.id, r.path, d["content_type"], d["title"], d["language"], {k: v if isinstance(v, str) else json.dumps(v) for k, v in d["metadata"].items()}, flat))
            yield pd.DataFrame(rows, columns=["id", "path", "content_type", "title", "language", "doc_metadata", "sections"])

    return docs.select("id", "path", "content_type", "content").mapInPandas(run, f"id string, path string, content_type string, title string, language string, doc_metadata map<string,string>, sections array<{_SECTION}>")


def extract_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of ``docs`` (id, path, content_type, content): code symbols, and infrastructure resources."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _some(batches):
            rows = []
            for r in batch.itertuples():
                d = parse(bytes(r.content or b""), r.content_type or "", r.path or "")
                source = bytes(r.content or b"").decode("utf-8", errors="replace")
                nodes, links = code.symbol_graph(d, source) if d["language"] == "python" else infra.graph(d)
                rows += [(r.id, "entity", n["type"], n["name"], n["display"], None) for n in nodes]
                rows += [(r.id, "edge", e["type"], e["source"], None, e["target"]) for e in links]
            yield pd.DataFrame(rows, columns=["document_id", "row", "kind", "name", "display_name", "target_name"])

    rows = docs.select("id", "path", "content_type", "content").mapInPandas(run, "document_id string, row string, kind string, name string, display_name string, target_name string")
    entities = rows.where("row = 'entity'").selectExpr("sha1(concat_ws(':', document_id, name)) as id", "document_id", "kind as entity_type", "name", "display_name")
    edges = rows.where("row = 'edge'").selectExpr("sha1(concat_ws(':', document_id, name)) as source_entity_id", "document_id", "kind as edge_type", "target_name")
    return entities, edges


RICH_TEXT = {"notion_blocks": markup.notion_blocks, "notion_property": lambda v: json.dumps(markup.notion_property(v), ensure_ascii=False), "adf": markup.adf}


def rich_text(column, kind: str):
    """JSON of a kind of RICH_TEXT as Markdown (a Notion property as JSON); null, or what isn't JSON, is null."""
    from pyspark.sql import functions as F

    render = RICH_TEXT[kind]

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return None if raw is None else render(json.loads(raw))
            except ValueError:
                return None

        return pd.Series([one(r) for r in rows])

    return run(column)
