"""Source divergence and the Merkle manifest against plain versions."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lodestone.llm import divergence, merkle

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(docs, min_docs, top):
    docs = [tuple(x or "" for x in d) for d in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df, groups = Counter(), {s: Counter() for _, s, _ in own}
        for _, source, text in own:
            terms = TERM.findall(text.translate(LOWER))
            df.update(set(terms))
            groups[source].update(terms)
        kept = [t for t, n in df.items() if n >= min_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, part, item, -v, k) for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])) for k, (v, _, item) in enumerate(rows, 1)}
    return out


@pytest.mark.parametrize(("block", "shard", "rounds"), [(1, 3, 1), (2, 1000, 16), (8, 2, 16)])
def test_audit(spark, block, shard, rounds):
    rnd = random.Random(block)
    word = lambda: rnd.choice(["Été", "b", "C", "dd", "e-f", "ÉTÉ", "straße", "x1y", "_q", "ﬀ", "zz", "a" * 40])
    docs = [(rnd.choice(["en", "fr", None, ""]), rnd.choice(["s1", "s2", "s10", None, "é", "S", "t"]), " ".join(word() for _ in range(rnd.randrange(12)))) for _ in range(120)]
    docs += [("xx", "only", "rare"), ("yy", "a", "once"), ("yy", "b", None), ("en", "empty", ""), ("en", "long", "b " * 50_000)] + [("fr", "copy", "dd dd b")] * 40
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "lang string, source string, text string, n int, term string")
    got = divergence.audit(df, min_docs=3, top=2, block=block, shard=shard, rounds=rounds)
    rows = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_audit(docs, 3, 2)
    assert divergence.audit(df.limit(0)).count() == 0
    assert not spark.sql("show tables").where("tableName like 'resident%'").count()


def test_every_two_blocks_meet_once(spark):
    for n in range(1, 10):
        last = n + n % 2 - 1
        rows = spark.range(n).selectExpr("cast(id as int) as block", f"{n} as blocks").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(max(1, last)))))
        got = rows.withColumn("host", divergence._partner(F.col("block"), F.col("round") - 1, F.col("blocks"))).where("host < blocks and host <> block").collect()
        met = Counter((r.block, r.host) for r in got)
        assert met == Counter((a, b) for a in range(n) for b in range(n) if a != b)
        assert all(len({r.host for r in got if r["round"] == k}) == sum(r["round"] == k for r in got) for k in range(1, last + 1))


def test_residents_are_not_shuffled(spark):
    one = spark.createDataFrame([("l", s, 1 + len(s)) for s in ("a", "b", "cc")], "lang string, source string, base long")
    entries = spark.createDataFrame([("l", "a", 5, 0, 9)], "lang string, source string, id long, shard int, p long")
    plans, keep = [], divergence.stored
    try:
        divergence.stored = lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name)
        divergence.distances(entries, one, spark.createDataFrame([("l", 0, 4)], "lang string, shard int, terms long"), block=1)
    finally:
        divergence.stored = keep
    plan = next(p for name, p in plans if name == "distances")
    met = plan[plan.index("SortMergeJoin") :]
    assert met.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in met  # the guests' alone


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(hashes, arity):
    """Root, and for each node its siblings upwards as (before, after)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k in range(len(hashes)):
            run = at[k] // arity * arity
            paths[k].append((level[run : at[k]], level[at[k] + 1 : run + arity]))
            at[k] //= arity
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def plain_manifest(docs, arity):
    leaf = lambda d: h(*(field(d[k]) for k in (0, 3, 2, 4, 1)))  # noqa: E731  doc_id, text, lang, source, n_chars
    tampered = lambda d: (*d[:4], d[4] + 1) if d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 else d
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(d), leaf(tampered(d))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = [climb([r[2] for r in sorted(groups[g])], arity) for g in order]
    root, above = climb([b[0] for b in below], arity)
    out = []
    for g, (subroot, paths), up in zip(order, below, above):
        for (known, d, own, now), path in zip(sorted(groups[g]), paths):
            for before, after in path + up:
                now = h(*before, now, *after)
            out.append((d if known else None, own, subroot, root, h(*(x for b, a in path + up for x in b + a)), now, now == root))
    return out


@pytest.mark.parametrize(("arity", "chunk"), [(2, 4), (2, 1024), (3, 9), (4, 5)])
def test_manifest(spark, monkeypatch, tmp_path, arity, chunk):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    rnd = random.Random(arity)
    docs = [(n if rnd.random() < 0.9 else None, rnd.choice(["", "é", "text", None]), rnd.choice(["en", "fr", None]), rnd.choice(["s", None]), rnd.choice([n, None])) for n in range(90)]
    docs += [(5, "x", "alone", "s", 1)] + [(7, "same", "en", "s", 4)] * 30 + [(-3, "t" * 100_000, "en", "s", 1), (8, "t", "", "s", 1)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    made = merkle.manifest(df, now={"n_chars": tampered}, arity=arity)
    got = Counter(tuple(r) for r in made.proofs().collect())
    assert got == Counter(plain_manifest(docs, arity)) and {r[-1] for r in got} == {True, False}
    made.write(str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("tree = 'below' and tier = 0").selectExpr("sum(count)").first()[0] == len(docs)
    assert merkle.manifest(df.limit(0)).proofs().count() == 0
