"""Packing, pieces, quality rules and top-k."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import packing, pieces, quality, topk

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_choose_is_exact():
    rnd = random.Random(1)
    for _ in range(200):
        counts = Counter(rnd.choice([1, 2, 5, 7, 11, 30]) for _ in range(rnd.randrange(8)))
        room = rnd.randrange(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        got = packing.choose(dict(counts), room)
        assert all(n <= counts[k] for k, n in got.items())
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


def check_pieces(rows, ids_of, capacity):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == capacity or at & (at - 1) == 0
    for doc, ids in ids_of.items():
        parts = sorted(docs.pop(doc), key=lambda r: r.start)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
        assert b"".join(r.ids for r in parts) == np.array(ids, "<u4").tobytes()
        assert {r.doc_tokens for r in parts} == {len(ids)}
    assert not docs


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 100)
    monkeypatch.setattr(packing, "WORDS", 50)
    rnd = random.Random(3)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    vocabulary = ["Hello", "wörld,", "don't", "x", "naïve...", "漢字", "a-b", "<|endoftext|>", "Q.", "İ"]
    texts = {i: " ".join(rnd.choice(vocabulary) for _ in range(int(rnd.expovariate(0.03)))) for i in range(120)}
    texts |= {200: None, 201: "", 202: " \n ", 203: "word " * 700}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("ids", packing.F.lit(0)).repartition(3)
    rows = packing.pack_documents(df, WORD_BPE, end=2, capacity=64).collect()
    check_pieces(rows, {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}, 64)
    assert packing.pack_documents(df.limit(0), WORD_BPE, end=2).count() == 0


def test_packing_query(spark, sf):
    rows = packing.op3_packing(spark, sf).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {d.doc_id: np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4") for d in docs}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))


def test_pieces_equal_the_library(spark, sf):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    rnd = random.Random(2)
    texts = ["  two  spaces ", "a\nb\tc", "", " ", "ÀÉ 漢字 \U0001f600", "▁x", "x" * 300, None] + ["".join(rnd.choice("ab the\n.漢é  ") for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(df, raw), raw).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].ids is None and got[i].decoded is None
        else:
            assert got[i].ids == sp.encode(t) and got[i].decoded == sp.decode(got[i].ids)
            assert got[i].decoded == t.replace("▁", " ")
    assert pieces.encode(df.limit(0), raw).count() == 0


def unigram(scores: dict[str, float]) -> bytes:
    """A unigram model as bytes, written by hand."""

    def field(n, payload):
        return bytes([n << 3 | 2, *([len(payload)] if len(payload) < 128 else [len(payload) & 127 | 128, len(payload) >> 7])]) + payload

    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([0x18, t])) for p, s, t in special + [(p, s, 1) for p, s in scores.items()])
    return body + field(2, bytes([0x18, 1])) + field(3, field(1, b"identity") + bytes([0x18, 1, 0x20, 0, 0x28, 1]))


def test_viterbi_equals_brute_force_and_the_library():
    rnd = random.Random(4)
    vocabulary = {p: -rnd.random() * 8 for p in ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "ca", "cab", "bca"]}
    raw = unigram(vocabulary)
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["".join(rnd.choice("aabbc d") for _ in range(rnd.randrange(1, 70))) for _ in range(200)]
    codec = pieces.Codec(raw)
    for t, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == sp.encode(t), t
    none = min(vocabulary.values()) - 10

    def best(s):
        table = [0.0] + [-math.inf] * len(s)
        for e in range(1, len(s) + 1):
            for a in range(e):
                v = vocabulary.get(s[a:e].replace(" ", "▁"), none if e - a == 1 else None)
                if v is not None:
                    table[e] = max(table[e], table[a] + v)
        return table[-1]

    for word in [" abcab", " cabbca", "bcabdab"]:
        ids = codec.model.encode_units([word])[0]
        assert sum(none if i == 0 else float(sp.get_score(int(i))) for i in ids) == pytest.approx(best(word), abs=1e-4)


def stats_of(text):
    w = (text or "").encode().split()
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, sf):
    rnd = random.Random(6)
    texts = [None, "", "a", "a b c a b c", "é x\n\nq", "x\ny\nx\n \n", "#$% a|b <>"] + [rnd.choice(" \n").join(rnd.choice("abé*") for _ in range(rnd.randrange(80))) for _ in range(100)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality.with_statistics(df).collect():
        want = stats_of(r.text)
        assert tuple(r[c] for c in quality.STATS) == want, r
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_learned_rules(spark):
    rnd = random.Random(8)

    def doc(bad):
        mark = rnd.choice(["***", "$$$"]) if bad and rnd.random() < 0.7 else ""
        size = 12 if bad and not mark else 5
        return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(size - 1, size + 2))) + mark for _ in range(70))

    rows = [(i, doc(i % 4 == 0), 0 if i % 4 == 0 else 1) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i < 400] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    assert 1 <= len(rules) <= 4 and all(str(r) for r in rules)
    judged = {r.doc_id: r.kept for r in quality.judge(docs, rules).collect()}
    held_out = [(judged[i], q == 1) for i, _, q in rows if i >= 400]
    assert sum(a == b for a, b in held_out) / len(held_out) > 0.95
    assert quality.fit(docs, labels.limit(0)) == [] and quality.judge(docs.limit(0), rules).count() == 0


@pytest.mark.parametrize("kind", ["random", "lengths", "close", "same"])
def test_top_k(spark, monkeypatch, kind):
    for name, size in (("BUCKET", 16), ("BLOCK", 3), ("GROUP", 2)):
        monkeypatch.setattr(topk, name, size)
    rnd = np.random.default_rng(7)
    v = rnd.normal(size=(150, 6))
    if kind == "lengths":
        v *= 10.0 ** rnd.integers(-2, 3, size=150)[:, None]
    if kind == "close":
        v = np.eye(6)[rnd.integers(0, 6, 150)] * rnd.integers(1, 5, 150)[:, None] + rnd.normal(size=(150, 6)) * 0.01
    if kind == "same":
        v[:] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(7, [1.0] * 6), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0, 2.0]), (905, [0.0] * 6), (None, [1.0] * 6), (10, [0.0] * 6)]
    ints = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(ints, ints.where("vec_id % 10 = 0"), k=4).collect())
    whole = [(i, [math.floor(1024 * x) for x in r]) for i, r in rows if i is not None and r is not None and all(x is not None and math.isfinite(x) for x in r)]
    asked = {}
    for i, r in whole:
        if i % 10 == 0:
            asked[i] = min(asked.get(i, r), r)
    want = []
    for q, a in asked.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))[:4]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want)
    assert topk.top_k(ints.limit(0), ints.limit(0)).count() == 0


def test_top_k_refuses_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.integer_vectors(df).collect()


def test_viterbi_breaks_ties_as_the_library():
    rnd = random.Random(11)
    checked = 0
    for _ in range(40):
        pieces_ = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 4))) for _ in range(6)} | {"a", "b"}
        raw = unigram({"▁": -1.0} | {p: float(-rnd.randrange(1, 4) * len(p)) for p in sorted(pieces_)})
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        texts = ["".join(rnd.choice("aabb c") for _ in range(rnd.choice([5, 20, 47, 48, 49, 60, 100]))) for _ in range(50)]
        for t, ids in zip(texts, pieces.Codec(raw).encode(texts)):
            assert ids.tolist() == sp.encode(t), t
            checked += 1
    assert checked == 2000


def test_unigram_reading_of_the_model_has_the_highest_sums(spark, sf):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = pieces.unigram_model(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    score = lambda ids: sum(sp.get_score(int(i)) for i in ids)
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for w in r.text.split(" ") if w and len(w) < 40})[::3]
    for w, ids in zip(words, pieces.Codec(raw).encode(words)):
        assert sp.decode(ids.tolist()) == w and score(ids) >= score(sp.nbest_encode_as_ids(w, 1)[0]) - 1e-3, w
    rows = pieces.sentencepiece_unigram(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r.round_trip for r in rows)


def test_pieces_query_equals_the_library(spark, sf):
    import hashlib

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pieces.op5_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_ids, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) and r.round_trip


def test_packing_with_any_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.by_word(WORD_BPE) and not packing.by_word(path)
    tokenizer = Tokenizer.from_file(path)
    texts = {0: "Hello  World, don't\n", 1: " x", 2: None, 3: "漢字 naïve " * 300}
    rows = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path, end=2, capacity=64).collect()
    check_pieces(rows, {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}, 64)


def test_quality_query_equals_a_plain_decision_list(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit(docs, labels)
    # Repeated rows in any order give the same rules.
    assert rules == quality.fit(docs.unionByName(docs).orderBy("text"), labels.unionByName(labels))
    texts = {r.doc_id: r.text for r in docs.collect()}
    number = {r.doc_id: r.rule for r in quality.judge(docs, rules).collect()}
    for r in quality.op4_quality_rules(spark, sf).collect():
        n, chars, symbols, dup, repeat = stats_of(texts[r.doc_id])
        row = {"n_words": n, "mean_word": chars / n if n else None, "symbol_share": symbols / n if n else None, "dup_lines": dup, "repeat_share": repeat / n if n else None}
        first = next((i for i, rule in enumerate(rules, 1) if all(row[f] is not None and (row[f] <= t if op == "<=" else row[f] > t) for f, op, t in rule.conditions)), None)
        failed = n < 50 or 100 * repeat > 50 * n
        assert (r.n_words, r.base_failed, r.kept, number[r.doc_id]) == (n, failed, not failed and first is None, first)


def test_a_condition_has_the_highest_gain():
    rnd = random.Random(12)
    for _ in range(50):
        rows = [(rnd.random() < 0.4, {"a": rnd.choice([None, 0.0, 1.0, 2.0, 3.0]), "b": rnd.random()}) for _ in range(30)]
        bad, good = [x for b, x in rows if b], [x for b, x in rows if not b]
        if not bad:
            continue

        def gain(f, op, t):
            p, n = (sum(1 for x in side if x[f] is not None and (x[f] <= t if op == "<=" else x[f] > t)) for side in (bad, good))
            return p * (math.log2(p / (p + n)) - math.log2(len(bad) / len(rows))) if p else 0.0

        cuts = {f: sorted({x[f] for _, x in rows if x[f] is not None}) for f in "ab"}
        best = max(gain(f, op, (u + v) / 2) for f in "ab" for u, v in zip(cuts[f], cuts[f][1:]) for op in ("<=", ">"))
        found = quality._best_condition(bad, good, ["a", "b"])
        assert found is None and best <= 1e-9 or gain(*found) == pytest.approx(best)
