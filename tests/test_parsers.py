from lodestone import parsers
from lodestone.parsers import code, infra, markup

TF = '''resource "aws_s3_bucket" "logs" {
  bucket = "x-${var.env}"
  tags = { a = "}" }
}

resource "aws_s3_bucket_policy" "p" {
  bucket     = aws_s3_bucket.logs.id
  policy     = var.policy
  depends_on = [aws_s3_bucket.logs]
}
locals {
  a = 1
}
'''
K8S = """apiVersion: apps/v1
kind: Deployment
metadata:
  name: web
  ownerReferences: [{kind: Thing, name: own}]
spec:
  selector: {matchLabels: {app: web}}
  template:
    spec:
      volumes: [{configMap: {name: conf}}]
      containers: [{envFrom: [{secretRef: {name: sec}}]}]
---
kind: Service
metadata: {name: svc, namespace: prod}
spec: {selector: {app: web}}
---
kind: : bad
---
kind: NoName
"""
PY = '''import os
import a.b as c
from x.y import z

@deco
class Foo(Base[int], object, metaclass=M):
    def run(self):
        print(helper(1))
        helper(2)
        self.other(3)

async def top():
    return 1
'''


def test_markdown():
    text = "---\ntitle: T\n---\nintro\n# One\nbody\n```py\n# no heading\n```\n## Two\n\n### Three ##\nlast\n# Four\n"
    d = markup.markdown(text)
    assert d["title"] == "T" and d["metadata"]["code_languages"] == ["py"]
    assert [(s["heading_path"], s["text"]) for s in d["sections"]] == [([], "intro"), (["One"], "body\n```py\n# no heading\n```"), (["One", "Two", "Three"], "last")]
    assert markup.markdown("plain")["sections"][0]["text"] == "plain" and markup.markdown("")["sections"] == []
    assert markup.plaintext("")["sections"][0]["line_end"] == 1 and markup.plaintext("a\nb")["sections"][0]["line_end"] == 2


def test_terraform():
    d = infra.terraform(TF)
    assert [s["symbol"] for s in d["sections"]] == ["resource.aws_s3_bucket.logs", "resource.aws_s3_bucket_policy.p", "locals"]
    assert (d["sections"][0]["line_start"], d["sections"][0]["line_end"]) == (1, 4)
    assert d["sections"][0]["metadata"]["refs"] == ["var.env"]
    assert d["sections"][1]["metadata"] | {"refs": d["sections"][1]["metadata"]["refs"]} == {"block_type": "resource", "depends_on": ["aws_s3_bucket.logs"], "refs": ["aws_s3_bucket.logs"], "resource_type": "aws_s3_bucket_policy", "resource_name": "p"}
    nodes, edges = infra.graph(d)
    assert [n["type"] for n in nodes] == ["terraform_resource", "terraform_resource", "terraform_block"]
    assert {(e["type"], e["target"]) for e in edges} == {("references", "var.env"), ("depends_on", "aws_s3_bucket.logs"), ("references", "aws_s3_bucket.logs")}
    j = infra.terraform_json('{"resource": {"t": {"n": {"depends_on": ["a.b"]}}}, "variable": {"v": {}}, "output": {"o": {}}}')
    assert [s["symbol"] for s in j["sections"]] == ["resource.t.n", "variable.v"] and j["sections"][0]["metadata"]["depends_on"] == ["a.b"]
    assert "parse_error" in infra.terraform_json("{")["metadata"]


def test_kubernetes():
    d = infra.kubernetes(K8S)
    assert [s["symbol"] for s in d["sections"]] == ["Deployment/default/web", "Service/prod/svc"]
    assert d["sections"][0]["metadata"]["volume_refs"] == ["ConfigMap/default/conf", "Secret/default/sec"]
    assert len(d["metadata"]["warnings"]) == 1
    _, edges = infra.graph(d)
    assert [(e["type"], e["source"], e["target"]) for e in edges] == [
        ("owns", "Thing/default/own", "Deployment/default/web"), ("selects", "Deployment/default/web", "pods"), ("mounts", "Deployment/default/web", "ConfigMap/default/conf"),
        ("mounts", "Deployment/default/web", "Secret/default/sec"), ("selects", "Service/prod/svc", "pods"), ("selects", "Service/prod/svc", "pods"),
    ]
    assert infra.kubernetes("a: 1") is None


def test_code():
    d = code.parse(PY, "src/mod.py")
    assert [s["symbol"] for s in d["sections"]] == ["mod.Foo", "mod.Foo.run", "mod.top"]
    nodes, edges = code.symbol_graph(d, PY)
    assert [(n["type"], n["display"]) for n in nodes] == [("module", "mod"), ("class", "Foo"), ("function", "run"), ("function", "top")]
    assert [e["target"] for e in edges if e["type"] == "imports"] == ["os", "a.b", "x.y"]
    assert [e["target"] for e in edges if e["type"] == "inherits"] == ["Base", "metaclass=M"]
    assert [e["target"] for e in edges if e["type"] == "calls" and e["source"] == "mod.Foo.run"] == ["helper", "other"]
    assert code.parse("def (", "a.py")["metadata"]["warning"] and code.parse("x = 1", "a.py") is None
    assert [s["symbol"] for s in code.parse("export class A {\n}\nexport async function b() {}\n", "m.ts")["sections"]] == ["m.A", "m.b"]


def test_members_of_other_languages():
    symbols = lambda text, path: [(s["symbol"], s["line_start"], s["line_end"]) for s in code.parse(text, path)["sections"]]
    ts = "export class A<T> {\n  x = '}';\n  async run(a: string): Promise<void> {\n    if (a) { b(); }\n  }\n  // }\n  get y() { return 1 }\n}\ninterface I { a: string }\ntype U = A | I;\nfunction f(\n  a,\n) {\n}\n"
    assert symbols(ts, "m.ts") == [("m.A", 1, 8), ("m.A.run", 3, 5), ("m.A.y", 7, 7), ("m.I", 9, 9), ("m.U", 10, 10), ("m.f", 11, 14)]
    java = "package p;\n@Deprecated\npublic class A extends B {\n  private int x = f(1);\n  @Override\n  public List<String> go(int a)\n      throws E {\n    for (;;) { }\n  }\n  static class In {\n    In() { super(); }\n  }\n}\n"
    assert symbols(java, "A.java") == [("A.A", 3, 13), ("A.A.go", 6, 9), ("A.A.In", 10, 12), ("A.A.In.In", 11, 11)]
    rust = "pub struct S { a: u8 }\nimpl<T> Tr for S {\n    pub fn go(&self) -> u8 {\n        '{' as u8\n    }\n}\nfn top() {}\n"
    assert symbols(rust, "l.rs") == [("l.S", 1, 1), ("l.S", 2, 6), ("l.S.go", 3, 5), ("l.top", 7, 7)]
    go = "package p\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Go() {\n\tx()\n}\n\nfunc top() {}\n"
    assert symbols(go, "g.go") == [("g.T", 3, 5), ("g.T.Go", 7, 9), ("g.top", 11, 11)]


def test_terraform_scanner():
    src = 'resource "a_b" "c" {\n  x = "${data.aws_ami.ubuntu.id} ${var.nn} }"\n  y = module.net.id\n  z = <<EOT\n} ${local.qq}\nEOT\n  # } a_b.comment\n  w = "a_b.text"\n  depends_on = [a_b.dd, "a_b.ee"]\n  v = aws_vpc.main[0].id\n}\n  resource "in" "dented" {}\nprovider "p" {}\n'
    d = infra.terraform(src)
    assert [s["symbol"] for s in d["sections"]] == ["resource.a_b.c", "provider.p"]
    assert d["sections"][0]["metadata"]["refs"] == ["a_b.dd", "aws_ami.ubuntu", "aws_vpc.main", "local.qq", "net.id", "var.nn"]
    assert d["sections"][0]["metadata"]["depends_on"] == ["a_b.dd", "a_b.ee"]


def test_dispatch_and_spark(spark):
    assert [parsers.choose("", p) for p in ("a.tf", "a.tf.json", "a.yml", "a.md", "a.py", "a.txt")] == ["terraform", "terraform", "kubernetes", "markdown", "code", "plaintext"]
    rows = [("1", "m.md", "text/markdown", b"# T\nx"), ("2", "mod.py", "", PY.encode()), ("3", "k.yaml", "", K8S.encode()), ("4", "n", None, None), ("5", "b.txt", "", b"\xff ok")]
    docs = spark.createDataFrame(rows, "id string, path string, content_type string, content binary")
    got = {r.id: r for r in parsers.parse_documents(docs).collect()}
    assert got["1"].title == "T" and len(got["2"].sections) == 3 and got["3"].sections[1].metadata["kind"] == "Service" and got["5"].sections[0].text == "� ok"
    entities, edges = parsers.extract_graph(docs)
    assert entities.where("entity_type = 'k8s_resource'").count() == 2 and edges.where("edge_type = 'inherits'").count() == 2


def test_rich_text():
    assert markup.adf({"type": "doc", "content": [{"type": "heading", "attrs": {"level": 2}, "content": [{"type": "text", "text": "H"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "b", "marks": [{"type": "strong"}]}]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "i"}]}]}]}]}) == "## H\n\n**b**\n\n- i\n"
    text = lambda t: [{"plain_text": t}]
    blocks = [{"type": "heading_1", "heading_1": {"rich_text": text("H")}}, {"type": "to_do", "to_do": {"rich_text": text("t"), "checked": True}, "children": [{"type": "paragraph", "paragraph": {"rich_text": text("c")}}]}, {"type": "odd", "odd": {}}]
    assert markup.notion_blocks(blocks) == "# H\n- [x] t\n  c\n<!-- odd -->"
    assert markup.notion_property({"type": "multi_select", "multi_select": [{"name": "a"}]}) == ["a"] and markup.notion_property({"type": "formula", "formula": {}}) is None


def test_parsing_is_spread_and_bounded(spark, sf):
    """Rows of one small file go to all partitions; Python holds a bounded number of documents, whatever a batch has."""
    import pandas as pd
    from pyspark.sql import functions as F

    from lodestone import parsers
    from lodestone.plans import derived

    for made in (derived._python(spark, sf), derived._terraform(spark, sf)):
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    batch = pd.DataFrame({"id": range(2 * parsers.HELD + 1)})
    parts = list(parsers._some(iter([batch, batch[:1]])))
    assert [len(p) for p in parts] == [parsers.HELD, parsers.HELD, 1, 1] and pd.concat(parts[:3])["id"].tolist() == list(range(len(batch)))
