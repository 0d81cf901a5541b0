"""Single repeated lines in the pipeline's line stage against brute force."""

import random

from test_dedup import WORDS

import corpus_pipeline
from lodestone.llm import line_dedup


def cut(docs, least_lines, least_words):
    """(doc_id, text, deleted lines); texts of one doc_id are taken to be equal."""
    places, first = [], {}
    for d, t in sorted({x for x in docs if x[0] is not None and x[1] is not None}):
        lines = t.split("\n")
        counted = [i for i, x in enumerate(lines) if WORDS.search(x)]
        for p, i in enumerate(counted):
            runs = [(p + least_lines, tuple(lines[j] for j in counted[p : p + least_lines]))] if p + least_lines <= len(counted) else []
            runs += [(p + 1, (lines[i],))] if len(WORDS.findall(lines[i])) >= least_words else []
            for end, run in runs:
                first.setdefault(run, (d, p))
                places.append((d, p, end, run))
    out = []
    for d, t in docs:
        if t is None:
            out.append((d, None, 0))
            continue
        lines = t.split("\n")
        counted = [i for i, x in enumerate(lines) if WORDS.search(x)]
        cuts = {(p, end) for e, p, end, run in places if e == d and d is not None and first[run] != (d, p)}
        starts = {p for p, end in cuts if end == p + least_lines}
        cuts |= {(p, end + 1) for p, end in cuts if end == p + least_lines and p + 1 in starts}
        dead = {i for p, end in cuts for i in range(counted[p], counted[end - 1] + 1)}
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in dead), len(dead & set(counted))))
    return out


def corpus():
    rnd = random.Random(4)
    pool = ["On.", "a b", "one two three", "c c c", "", " \t", "q w e r t y u i o p", " s  d f g\th "]
    docs = [(i, "\n".join(rnd.choice([*pool, *[f"u{rnd.random()} x"] * 3]) for _ in range(rnd.randrange(12)))) for i in range(60)]
    return docs + [docs[0], (None, docs[1][1]), (60, None), (61, ""), (62, "a b c d e f\n" * 9), (63, "a b c d e f"), (64, "On."), (65, "x\na b c d e f\ny")]


def test_single_lines_match_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    for words in (1, 3, 5, 6):
        got = [(r.doc_id, r.text, r.n_deleted) for r in line_dedup.dedup_lines(df, min_words=words).collect()]
        assert sorted(got, key=key) == sorted(cut(docs, 2, words), key=key), words


def test_stage_cuts_long_single_lines_only(spark, sf):
    docs = [(1, "first\na line of five words\nlast\nOn."), (2, "other\na line of five words\nOn.\nend"), (3, "a line of five words"), (4, "a line of four")]
    df = spark.createDataFrame([*docs, (5, "a line of four")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, sf).collect()}
    assert got == {1: docs[0][1], 2: "other\nOn.\nend", 3: "", 4: docs[3][1], 5: docs[3][1]}
