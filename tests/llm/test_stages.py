"""Every pipeline stage on odd rows: nulls, empty and repeated ones, clashing columns, an empty table; and a hub of links."""

import pytest

import corpus_pipeline
from lodestone.llm._common import components

LONG = " ".join(f"word{i} other{i % 7}" for i in range(80))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, n_words long, spans string"


def rows():
    base = [(1, LONG), (2, LONG + " end"), (2, LONG + " end"), (None, LONG), (3, None), (4, ""), (5, " \n\t\n"), (6, "short"), (7, LONG.replace("word4 ", "new ")), (8, "x " * 5000 + LONG)]
    return [(d, t, "en", "s", None if t is None else len(t), False, 1, 2, "c") for d, t in base]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = stage(spark, docs, sf)
    got = out.collect()
    if name != "packing":
        assert out.dtypes == docs.dtypes
        # What a table has of its own stays what it was, whatever an operator calls its columns.
        assert {(r.lang, r.source, r.kept, r.fp, r.n_words, r.spans) for r in got} <= {("en", "s", False, 1, 2, "c")}
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    texts = {(r.doc_id, r.text) for r in got} if name != "packing" else set()
    if name == "quality_rules":
        assert all(r.text and len(r.text.split()) >= 50 for r in got)
    if name == "line_dedup":
        assert len(got) == len(rows()) and {(1, LONG), (None, LONG), (3, None), (4, ""), (6, "short")} <= texts
    if name == "simhash":
        # Copies go with the first one; texts without words are nobody's copies, and a row without an id stays.
        assert texts == {(1, LONG), (None, LONG), (3, None), (4, ""), (5, " \n\t\n"), (6, "short")}
    if name == "substring_dedup":
        assert len(got) == len(rows()) and {(1, LONG), (None, LONG), (3, None), (6, "short")} <= texts
        assert {r.text for r in got if r.doc_id == 2} == {"end"}
    if name == "packing":
        assert {r.doc_id for r in got} == {r[0] for r in rows()} and sorted(r.length for r in got if r.doc_id in (3, 4, 5)) == [1, 1, 1]
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_a_hub_of_links(spark):
    n = 10_000
    edges = spark.range(1, n).selectExpr("id as a", "0L as b").unionByName(spark.range(1, n, 100).selectExpr("id as a", "id + 1000000 as b")).unionByName(spark.createDataFrame([(-5, -7), (-7, -9), (3, 3)], "a long, b long"))
    got = components(edges)
    assert got.count() == n + 100 + 3
    assert {(r.root, r["count"]) for r in got.groupBy("root").count().collect()} == {(0, n + 100), (-9, 3)}
