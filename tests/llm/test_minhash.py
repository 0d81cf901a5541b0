"""Circulant MinHash, its operator and the pipeline's near-duplicate stage against all pairs of shingle sets."""

import random
from fractions import Fraction

import numpy as np
import pytest
from test_dedup import WORDS

import corpus_pipeline
from lodestone.llm import minhash, simhash


def shingles(text):
    words = WORDS.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(docs, least=Fraction(4, 5)):
    """The least doc_id that pairs of that similarity or more reach, by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [min(d for k, (d, _) in enumerate(docs) if d is not None and find(k) == find(i)) for i in range(len(docs))]


def edited(rnd, words, n):
    """Each of n words, at least five apart, becomes a new one: 5 * n shingles change."""
    words = list(words)
    for at in rnd.sample(range(4, len(words) - 8, 6), n):
        words[at] = f"new{rnd.random()}"
    return " ".join(words)


def corpus():
    rnd = random.Random(3)
    text = lambda: [f"w{rnd.randrange(5000)}" for _ in range(300)]
    docs, n = [], 0
    for edits in range(1, 9):  # similarities of 0.97 to 0.76 between a text and its copy
        words = text()
        docs += [(n, " ".join(words)), (n + 1, edited(rnd, words, edits))]
        n += 2
    family = text()
    docs += [(n + k, edited(rnd, family, rnd.randrange(1, 5))) for k in range(80)]
    far = text()
    docs += [(200 + k, edited(rnd, far, 7)) for k in range(40)]  # alike, but under 0.8 to each other
    docs += [(300, ""), (301, None), (302, " \n"), (303, "one two"), (304, "One two"), (305, "one"), (None, docs[0][1]), (0, docs[0][1])]
    return docs


@pytest.mark.parametrize(("crowd", "similarity", "leads"), [(1, 0.8, 2), (64, 0.8, 2), (1, 0.85, 1), (8, 0.85, 2)])
def test_all_pairs_of_similarity_are_linked(spark, monkeypatch, crowd, similarity, leads):
    monkeypatch.setattr(minhash, "LEADS", leads)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, fp int, mark int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, similarity=similarity, crowd=crowd).collect()))
    assert got == sorted((d is None, d or 0, len(shingles(t)), c) for (d, t), c in zip(docs, linked(docs, Fraction(str(similarity)))))
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_blocks_find_what_leaders_do_not(spark):
    """Two families that share their middle: sets at exactly the threshold link, one shingle less does not."""
    sets = {k: np.arange(k, k + 92, dtype=np.uint64) for k in range(0, 80, 4)}  # neighbours: 88 of 96
    rows = [(7, k, k, len(s)) for k, s in sets.items()]
    now = spark.createDataFrame(rows, "key long, fp long, root long, size long")
    full = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "fp long, grams binary")

    def links(similarity):
        got = minhash._blocks_met(now, now.select("key", "fp"), full, similarity)
        return {(min(r.a, r.b), max(r.a, r.b)) for r in got.collect()}

    assert links(88 / 96) == {(k, k + 4) for k in range(0, 76, 4)} and links(0.92) == set()


def test_circulant_signatures_estimate_similarity():
    rnd = np.random.Generator(np.random.PCG64(1))
    x = rnd.integers(0, 1 << 64, 4000, np.uint64)
    mixed = minhash._mixed((np.arange(1 << 16, dtype=np.uint64) * 65537).astype(np.uint32), 0x9E3779B1, 0x7FEB352D, 16)
    assert len(np.unique(mixed)) == 1 << 16  # a permutation has no ties
    for common in (1000, 3000, 3600):
        a, b = x[:common], x[common // 4 : common]
        rows = minhash.signature(np.concatenate([a, b]), np.array([0, len(a)]), 400)
        assert abs((rows[0] == rows[1]).mean() - len(b) / len(a)) < 0.1
    assert minhash.bands(0.85) == 20 and (1 - 0.8**5) ** minhash.bands(0.8) <= minhash.MISS


def test_stage_removes_copies_of_similarity_over_80_percent(spark, sf):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, df, sf).collect())
    assert got == sorted((d is None, d or 0) for (d, _), c in zip(docs, linked(docs)) if d is None or d == c)


def test_fingerprints_find_what_is_nearest_without_keys(spark, monkeypatch):
    """Without any key of minima the near copies within three bits link, and what full sets refuse does not."""
    docs = corpus()
    rnd = random.Random(6)
    docs += [(400, " ".join(f"w{rnd.randrange(5000)}" for _ in range(20)) + " a b c d e" * 300), (401, " ".join(f"w{rnd.randrange(5000)}" for _ in range(20)) + " a b c d e" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    fps = [(r.doc_id, r.fp & (1 << 64) - 1, shingles(r.text)) for r in simhash.fingerprints(df, shingle=5).collect() if shingles(r.text)]
    near = {(a, b): len(x & y) >= 0.8 * len(x | y) for a, f, x in fps for b, g, y in fps if a is not None and b is not None and a < b and (f ^ g).bit_count() <= 3}
    assert sum(near.values()) > 3 and not near[400, 401]
    monkeypatch.setattr(minhash, "_sets", no_keys(minhash._sets))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, similarity=0.8).collect() if r.doc_id is not None}
    assert all((got[a] == got[b]) == alike for (a, b), alike in near.items() if b < 16 or a >= 400)
    alone = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, similarity=0.8).collect() if r.doc_id is not None}
    assert any(got[a] == got[b] and alone[a] != alone[b] for a, b in near)


def no_keys(sets):
    """``minhash._sets`` without the keys."""

    def of(*args):
        run = sets(*args)

        def bare(batches):
            import pyarrow as pa

            for b in run(batches):
                yield b.set_column(b.schema.get_field_index("keys"), "keys", pa.array([[]] * b.num_rows, pa.list_(pa.int64())))

        return bare

    return of


def test_components_by_rounds_and_in_one_task_agree(spark):
    from lodestone.llm._common import components

    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, many = ({(r.node, r.root) for r in components(df, one_task=n).collect()} for n in (10_000, 0))
    assert one == many and len(one) > 100
