import base64
import gzip
import hashlib
import random

import pytest

from lodestone.llm import warc
from lodestone.llm.url_filter import RULES, filter_urls


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:n], rest[n:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("ranges", [1, 3, 9])
def test_urls_match_brute_force(spark, ranges):
    rnd = random.Random(ranges)
    hosts = ["com", "a.com", "b.a.com", "A.com", "ab.com", "com.a", "xcom", "net", "n.net", "a.com.", "a-b.com", "ü.com", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/fr/", "/en/x/y"]
    rules = list({(h, p): (h, p, v) for h, p, v in ((rnd.choice(hosts), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(25))}.values()) + [(None, "/", "block"), ("a.com", None, "block")]
    urls = [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=/en/', '#x', '/z'])}" for _ in range(300)] + [None, "", "a.com/en/", "x://a://b.com/en/", "http://a.com?x", "http://a.com#/en/"] + ["http://a.com/en/x"] * 100
    pages = spark.createDataFrame([(i % 320, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    known = [(h.lower() if h else h, p, v) for h, p, v in rules]
    got = filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=ranges).collect()
    want = [(i % 320, u, *judge(u, [k for k in known if k[0] and k[1] is not None])) for i, u in enumerate(urls)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got), key=key) == sorted(want, key=key)


def test_urls_empty(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([], "page_id long, url string, tags map<string,string>")
    assert filter_urls(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://example.com/en/", {"a": "b"})], pages.schema)
    assert filter_urls(one, rules.limit(0)).first().verdict == "allow" and filter_urls(one, rules).first().rule == "example.com/en/"


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a.com/x", "hällo"), (2, "http://b.a.com/", "hällo"), (3, None, None), (4, "http://c/ü?q", ""), (5, "http://a.com/x", "z" * 3_000_000), (5, "http://a.com/x", "z" * 3_000_000), (None, "http://n/", "hällo"), (None, "http://n/", "only"), (9, "bad\r\nline", "z\r\n\r\nz")]
    pages = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "page_id long, url string, html string, payload int")
    entries, directory = warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(directory, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) == entries.count()
    b32 = lambda s: base64.b32encode(hashlib.sha1(s).digest()).decode()
    want = []
    for page, url, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(same, default=None)
        revisit = first is not None and first != page
        want.append((page, url, len(body), b32(body), "revisit" if revisit else "response", first if revisit else None, None if revisit else body))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in got), key=key) == sorted(want, key=key)
    assert [r.page_id for r in warc.lookup(directory, str(tmp_path / "w"), "http://b.a.com/").collect()] == [2]
    assert warc.lookup(directory, str(tmp_path / "w"), "http://zz/").count() == 0
    member = next((tmp_path / "w" / "records").iterdir()).read_bytes()
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_archives_blocks_and_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 4}.com/{i % 5}", f"t{i % 7}") for i in range(40)], "page_id long, url string, html string")
    _, directory = warc.write_archives(pages, str(tmp_path / "a"))
    assert directory.count() >= 10
    assert {r.page_id for r in warc.lookup(directory, str(tmp_path / "a"), "http://h1.com/1").collect()} == {1, 21}
    assert warc.read_archives(directory, str(tmp_path / "a")).count() == 40
    entries, none = warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert entries.count() == 0 and warc.read_archives(none, str(tmp_path / "b")).count() == 0


def test_lookups_of_many_urls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rnd = random.Random(5)
    urls = [f"http://h{rnd.randrange(6)}.com/{rnd.randrange(4)}" for _ in range(60)] + ["http://hot.com/"] * 40 + [None, "no url"]
    pages = spark.createDataFrame([(i, u, f"t{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    _, directory = warc.write_archives(pages, str(tmp_path / "a"))
    asked = ["http://h1.com/1", "http://hot.com/", "http://HOT.com/?q", None, "http://zz/", "http://h5.com/3", "http://h5.com/3"]
    got = warc.lookup_all(directory, str(tmp_path / "a"), spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    assert sorted(r.page_id for r in got) == sorted(i for i, u in enumerate(urls) if u in asked or u in (None, "no url"))
    assert all(bytes(r.payload) == f"t{r.page_id}".encode() for r in got)


def test_stores():
    assert warc._uri("s3a://b/x") == "s3://b/x" and warc._uri("file:/a/b") == "/a/b" == warc._uri("/a/b")
    with pytest.raises(ValueError):
        warc._uri("wasbs://c@a/x")
