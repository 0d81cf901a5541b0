"""Substring, line and near-duplicate removal against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import line_dedup, simhash, substring_dedup
from lodestone.llm.substring_dedup import dedup_substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(docs, window):
    """(doc_id, kept words) by comparing all windows."""
    first = {}
    for d, t in docs:
        w = WORDS.findall(t or "")
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in docs:
        w = WORDS.findall(t or "")
        gone = {i + k for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for k in range(window)}
        out.append((d, [x for i, x in enumerate(w) if i not in gone]))
    return out


def corpus(seed, n=60, window=6):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh")
    passages = [[word() for _ in range(rnd.randrange(window, 4 * window))] for _ in range(5)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rnd.randrange(4)):
            w += [word() for _ in range(rnd.randrange(12))] + rnd.choice(passages)[rnd.randrange(3) :]
        docs.append((rnd.randrange(n), rnd.choice([" ", "\n", "  "]).join(w)))
    docs += [docs[0], (None, docs[1][1]), (3, None), (4, ""), (5, "a " * 300), (6, "a " * 200)]
    return docs


@pytest.mark.parametrize("seed,stretch", [(1, 400_000), (2, 400_000), (3, 20)])
def test_substrings_match_brute_force(spark, monkeypatch, seed, stretch):
    monkeypatch.setattr(substring_dedup, "STRETCH", stretch)
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, spans int")
    got = dedup_substrings(df, window=6, anchor=2).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted(((r.doc_id, WORDS.findall(r.text or "")) for r in got), key=key) == sorted(cut_words(docs, 6), key=key)
    assert all(r.n_words - r.n_removed == len(WORDS.findall(r.text or "")) for r in got)
    assert all(r.text is None for r in got if r.doc_id == 3 and r.n_words == 0 and r.text is None)


def test_substrings_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, "x " + long), (2, long + " y\n z"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_substrings(df).collect()}
    assert got[2].text == "y\n z" and got[2].n_removed == 60 and [tuple(s) for s in got[2].spans] == [(0, 60)]
    assert got[1].text == "x " + long and got[3].text == "short"
    assert dedup_substrings(df.limit(0)).count() == 0


def cut_lines(docs, least):
    keyed = {}
    places = []
    for d, t in sorted({x for x in docs if x[0] is not None and x[1] is not None}, key=lambda x: x[0]):
        lines = t.split("\n")
        counted = [i for i, x in enumerate(lines) if WORDS.search(x)]
        for p in range(len(counted) - least + 1):
            run = tuple(lines[i] for i in counted[p : p + least])
            places.append((d, t, p, run))
    for d, t, p, run in places:
        keyed.setdefault(run, (d, t, p))
    gone = {}
    for d, t, p, run in places:
        if keyed[run] != (d, t, p):
            gone.setdefault((d, t), set()).add(p)
    out = []
    for d, t in docs:
        if t is None:
            out.append((d, None))
            continue
        lines = t.split("\n")
        counted = [i for i, x in enumerate(lines) if WORDS.search(x)]
        dead = set()
        for p in gone.get((d, t), ()):
            dead |= set(range(counted[p], counted[p + least - 1] + 1))
        starts = sorted(gone.get((d, t), ()))
        for a, b in zip(starts, starts[1:]):
            if b - a == 1:
                dead |= set(range(counted[a], counted[b + least - 1] + 1))
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in dead)))
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lines_match_brute_force(spark, least):
    rnd = random.Random(least)
    docs = [(i, "\n".join(rnd.choice(["a", "b", "c c", "", " ", "d"] + [f"u{rnd.random()}"] * 3) for _ in range(rnd.randrange(12)))) for i in range(50)]
    docs += [docs[0], (None, docs[1][1]), (60, None), (61, ""), (62, "x\n" * 40)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_lines int")
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(df, min_lines=least).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=key) == sorted(cut_lines(docs, least), key=key)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def fingerprint(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = WORDS.findall(words)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    x = np.array(fps, np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)):
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STRETCH", 50)
    rnd = random.Random(5)
    base = [" ".join(rnd.choice(["Ab", "cd", "é", "ef", "gh"]) for _ in range(200)) for _ in range(4)]
    docs = [(i, t) for i, t in enumerate(base)] + [(10 + i, t.replace("cd", "CD", 3)) for i, t in enumerate(base)] + [(20, None), (21, ""), (22, "one"), (23, "one two"), (10, base[0]), (None, base[1])]
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, fp int")).collect()}
    fps = [fingerprint(t) for _, t in docs]
    assert {(d, f) for d, f in got} == {(d, int(np.uint64(f).view(np.int64))) for (d, _), f in zip(docs, fps)}
    comp = classes(fps)
    for (d, _), f, c in zip(docs, fps, comp):
        want = min(x for (x, _), k in zip(docs, comp) if k == c and x is not None)
        assert got[d, int(np.uint64(f).view(np.int64))] == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_keys_lose_no_link(spark):
    """A dense family, chains of 3-bit steps out of it, and unrelated fingerprints; all crowded, partly, and not at all."""
    rnd = random.Random(9)
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(64), n))
    center = rnd.getrandbits(64)
    fps = {flip(center, rnd.randrange(4)) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)}
    for _ in range(3):
        x = center
        for _ in range(5):
            x = flip(x, 3)
            fps.add(x)
    fps = sorted(fps)
    roots = classes(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for crowd in (1, 8, 10_000):
        got = {r.node: r.root for r in simhash.link(df, crowd=crowd).collect()}
        groups = {}
        for f, c in zip(signed, roots):
            groups.setdefault(c, []).append(f)
        assert got == {f: min(g) for g in groups.values() if len(g) > 1 for f in g}, crowd


def test_linking_fingerprints_broadcasts_nothing(spark):
    """Of small tables, which Spark would broadcast, too: what the driver holds doesn't grow with the input."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    family = [(i, " ".join(f"w{j}" for j in range(400)) + f" x{i}") for i in range(100)]
    docs = spark.createDataFrame([*family, (200, "a b c d"), (201, "a b c d"), (202, None)], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 103
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
    assert plans and not [p for p in plans if "BroadcastExchange" in p]
