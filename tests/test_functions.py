import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import convert, entities, text
from lodestone.functions.vectors import cosine, literal
from lodestone.operators.fulltext import english_stem


def values(spark, column, rows, schema="a string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def normalized(s: str) -> str:
    """A plain model of the rule."""
    lines, out, blank = [x.rstrip() for x in s.lstrip("﻿").splitlines()], [], False
    for line in lines:
        if not line:
            blank = True
            continue
        out += [""] * blank + [line]
        blank = False
    return "\n".join(out)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\r\x0b\x0c\x1c\x85 \xa0﻿", max_size=30), min_size=40, max_size=40))
def test_normalize_matches_model(spark, samples):
    assert values(spark, text.normalize_content(F.col("a")), samples) == [normalized(s) for s in samples]


def test_hash(spark):
    got = values(spark, text.content_hash(F.col("a")), ["hello", "﻿hello  \n\n", "foo"])
    assert got[0] == got[1] == hashlib.sha256(b"hello").hexdigest() != got[2]


@pytest.mark.parametrize("size,overlap", [(10, 3), (5, 0), (5, 2), (5, 5), (1, 0)])
def test_windows(spark, size, overlap):
    samples = [" ".join(f"w{i}" for i in range(n)) for n in range(0, 23)]
    got = values(spark, text.windows(text.split_words(F.col("a")), size, overlap), samples)
    step = max(1, size - overlap)
    for s, windows in zip(samples, got):
        words, want, at = s.split(), [], 0
        while words:
            want.append(" ".join(words[at : at + size]))
            if at + size >= len(words):
                break
            at += step
        assert windows == want


def test_section_chunks(spark):
    long = " ".join(f"w{i}" for i in range(9))
    rows = [("d", [{"heading_path": ["A", "B"], "text": "short", "line_start": 1, "line_end": 2, "symbol": "s", "metadata": {"k": "v"}}, {"heading_path": [], "text": " ", "line_start": 3, "line_end": 3, "symbol": None, "metadata": {}}, {"heading_path": ["C"], "text": long, "line_start": 4, "line_end": 5, "symbol": "t", "metadata": {}}])]
    docs = spark.createDataFrame(rows, "id string, sections array<struct<heading_path:array<string>,text:string,line_start:int,line_end:int,symbol:string,metadata:map<string,string>>>")
    got = text.with_ordinal(text.code_symbol_chunks(docs, max_words=4, overlap=1), "id").orderBy("ord").collect()
    assert [r.chunk_text for r in got] == ["A > B\n\nshort", "C\n\nw0 w1 w2 w3", "C\n\nw3 w4 w5 w6", "C\n\nw6 w7 w8"]
    assert [r.ord for r in got] == [0, 1, 2, 3]
    assert got[0].metadata == {"strategy": "code_symbol", "line_range": "[1, 2]", "k": "v"} and got[2].metadata["window_index"] == "1"
    # The prefix counts for Markdown: four words and a heading of one are more than four.
    four = docs.selectExpr("id", "array(named_struct('heading_path', array('C'), 'text', 'a b c d', 'line_start', 1, 'line_end', 1, 'symbol', cast(null as string), 'metadata', cast(map() as map<string,string>))) as sections")
    assert text.markdown_section_chunks(four, max_words=4, overlap=1).count() == 1
    assert text.markdown_section_chunks(four, max_words=4, overlap=1).first().metadata["section_path"] == "C"


def test_names(spark):
    got = values(spark, entities.normalize_name(F.col("a")), ["aws_s3_bucket", "Deployment/nginx", "my.service.name", "azurerm_resource_group", "aws_k8s_foo", "k8s-nginx-pod", "MyService"])
    assert got == ["s3_bucket", "deployment_nginx", "my_service_name", "resource_group", "foo", "k8s_nginx_pod", "myservice"]
    pairs = spark.createDataFrame([("my-service", "my_service"), ("", "x"), ("aws_", "tf_"), ("aws_instance.nginx", "nginx-deployment"), ("postgres_database", "redis_cache")], "a string, b string")
    rows = pairs.select(entities.exact_name_match(F.col("a"), F.col("b")), entities.resource_name_match(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert rows[0][1] == 1.0 and rows[3][1] >= 0.4 and rows[4][1] < 0.5


def test_markdown_conversion(spark):
    html = ["<h1>Title</h1>", "<ul><li>Item A</li></ul>", "a &amp; b", "&#65;&#x42;c&#128512;", "<pre>x</pre><table><tr><td>1</td></tr></table>", '<ac:structured-macro ac:name="code">zz</ac:structured-macro>']
    got = values(spark, convert.storage_to_markdown(F.col("a")), html)
    assert got == ["# Title", "- Item A", "a & b", "ABc\U0001f600", "x\n```\n\n| 1 | |", "```\n```"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([-1.0, 0.0],), ([0.0, 2.0],)], "v array<double>")
    assert [r[0] for r in df.select(cosine(F.col("v"), literal([1.0, 0.0]))).collect()] == [1.0, 0.0, -1.0, 0.0]
    with pytest.raises(Exception, match="differ in length"):
        df.select(cosine(F.col("v"), literal([1.0]))).collect()


def test_english_stems():
    """From the algorithm's published sample."""
    want = {
        "consigned": "consign", "consistency": "consist", "consolatory": "consolatori", "consolingly": "consol", "conspicuously": "conspicu", "conspiracy": "conspiraci", "constables": "constabl", "constancy": "constanc",
        "knackeries": "knackeri", "knavish": "knavish", "knees": "knee", "knell": "knell", "knightly": "knight", "knitting": "knit", "knives": "knive", "skies": "sky", "dying": "die", "generate": "generat", "generic": "generic",
        "hopping": "hop", "hoping": "hope", "ties": "tie", "cries": "cri", "say": "say", "by": "by", "proceed": "proceed", "sensibility": "sensibl", "é": "é",
    }
    assert {w: english_stem(w) for w in want} == want



def test_slack_and_types(spark):
    row = spark.range(1).select(convert.slack_message(F.lit("u"), F.lit("1700000000.5"), F.lit("hi"), F.array(F.lit(" "), F.lit("att"))))
    assert row.first()[0] == "**u** (2023-11-14 22:13 UTC)\nhi\natt"
    assert re.fullmatch(r"x{57}\.\.\.", spark.range(1).select(convert.shortened(F.lit("x" * 61))).first()[0])
