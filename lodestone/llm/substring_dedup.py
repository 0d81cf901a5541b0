"""Substring dedup by De Bruijn compaction.

Every window of WINDOW words is an edge of the corpus's De Bruijn graph. Within a text, windows that follow each other and
share their minimizer (the least hash among the ANCHOR-word sequences in a window) are one node, which travels as one row:
anchor, content hash and source coordinates. The rest runs as joins:

1. Anchors that occur once in the corpus are unique text and leave at once.
2. Nodes that documents share are compacted: an edge between two nodes doesn't branch if it is passed as often as each of
   them, that is if every holder of the one goes on to the other and every holder of the other comes from the one. Pointer
   doubling over such edges names each node by the head of its path, so that a repeated passage becomes one span of each
   holder, whatever its length.
3. Spans are read at their source coordinates, and the SHA-256 of their words decides: a span goes if a document with a
   smaller id has the same words.
4. Where an anchor has several different nodes the graph branches; only there are the first holders' nodes undone into single
   windows, read at their source coordinates and compared (by 64 bits of the anchor and 64 of the window).

A window's minimizer depends on its words alone, so that equal windows always meet: the result equals that of comparing all
windows. Groups are reduced to counts and minima, and these are stored, before they are joined back: a hot passage costs one
row for each copy, never a pair, and AQE splits the joins at it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._common import SPACE, free, stored

WINDOW = 50
ANCHOR = 8
#: Words hashed at once; longer texts are cut into overlapping stretches.
STRETCH = 400_000
#: Multipliers of the rolling hashes (odd).
_R1, _R2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _hasher(window: int, anchor: int):
    """A function from a list of words to (minimizers, function of window hashes) as numpy arrays."""
    import numpy as np
    import xxhash

    powers: dict[int, tuple] = {}

    def power(r: int, n: int):
        up, down = powers.get(r, (np.empty(0, np.uint64), None))
        if len(up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, r, np.uint64), np.full(size, pow(r, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            powers[r] = up, down = np.cumprod(up), np.cumprod(down)
        return up[:n], down[:n]

    def mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def prefix(h, r):
        up, down = power(r, len(h) + 1)
        p = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[:-1], out=p[1:])
        return lambda i, j: (p[j] - p[i]) * down[i]

    def hashes(words: list[bytes]):
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = len(h)
        at = prefix(h, _R2)
        i = np.arange(n - anchor + 1)
        low = mix(at(i, i + anchor))
        span, have = window - anchor + 1, 1
        while have < span:  # least over 2, 4, 8 ... anchors
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        at = prefix(h, _R1)
        return low, lambda i, n: mix(at(i, i + n + (window - 1)) ^ n.astype(np.uint64))

    return hashes


def _stretches(texts: list[bytes | None], window: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int, int]]]]:
    """Words of several texts together, with (row, first word in its text, place, length) of each stretch."""
    words: list[bytes] = []
    parts: list[tuple[int, int, int, int]] = []
    for row, text in enumerate(texts):
        own = (text or b"").split()
        if len(own) < window:
            continue
        for start in range(0, len(own) - window + 1, STRETCH):
            piece = own[start : start + STRETCH + window - 1] if len(own) > STRETCH + window else own
            if words and len(words) + len(piece) > STRETCH:
                yield words, parts
                words, parts = [], []
            parts.append((row, start, len(words), len(piece)))
            words.extend(piece)
            if piece is own:
                break
    if parts:
        yield words, parts


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


_PATHS = "anchor long, hash long, doc long, mark long, start int, n int"


def _paths(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hashes = _hasher(window, anchor)
        for batch in batches:
            doc, mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "mark"))
            for words, parts in _stretches(_texts(batch), window):
                low, content = hashes(words)
                row, first, place, size = (np.array(x, np.int64) for x in zip(*parts))
                last = place + size - window  # of each part, the last window
                valid = np.zeros(len(low), np.int8)
                fresh = np.zeros(len(low), bool)
                for p, q in zip(place, last):
                    valid[p : q + 1] = 1
                fresh[1:] = low[1:] != low[:-1]
                fresh[place] = True
                i = np.flatnonzero(fresh & (valid == 1))
                of = np.searchsorted(place, i, "right") - 1
                n = np.minimum(np.append(i[1:], len(low)), last[of] + 1) - i
                yield pa.RecordBatch.from_arrays(
                    [low[i].view(np.int64), content(i, n).view(np.int64), doc[row[of]], mark[row[of]], (i - place[of] + first[of]).astype(np.int32), n.astype(np.int32)],
                    ["anchor", "hash", "doc", "mark", "start", "n"],
                )

    return run


_WINDOWS = "anchor long, hash long, doc long, mark long, start int, n int, words binary"


def _windows(window: int, anchor: int):
    """What ``__ranges`` of each row list: the single windows of forks, and spans as a whole with the SHA-256 of their words.
    Rows without any are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        import numpy as np

        hashes = _hasher(window, anchor)
        names = ["anchor", "hash", "doc", "mark", "start", "n", "words"]
        for batch in batches:
            batch = batch.filter(batch.column("__ranges").is_valid())
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ranges, docs, marks, texts = (*(some.column(c).to_pylist() for c in ("__ranges", "doc", "mark")), _texts(some))
                spans = []
                for own, doc, mark, text in zip(ranges, docs, marks, texts):
                    whole = [r for r in own if r["anchor"] is not None]
                    words = text.split() if whole else []
                    spans += [(r["anchor"], r["hash"], doc, mark, r["start"], r["n"], sha256(b" ".join(words[r["start"] : r["start"] + r["n"] + window - 1])).digest()) for r in whole]
                if spans:
                    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*spans), kinds)], names)
                forks = [[r for r in own if r["anchor"] is None] for own in ranges]
                for words, parts in _stretches([t if f else None for t, f in zip(texts, forks)], window):
                    low, content = hashes(words)
                    for row, first, place, size in parts:
                        cut = [(max(p["start"], first), min(p["start"] + p["n"], first + size - window + 1)) for p in forks[row]]
                        own = [np.arange(a, b) for a, b in cut if a < b]
                        if own:
                            start = np.unique(np.concatenate(own))
                            i, one = start - first + place, np.ones(len(start), np.int64)
                            columns = [low[i].view(np.int64), content(i, one).view(np.int64), one * docs[row], one * marks[row], start.astype(np.int32), one.astype(np.int32)]
                            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(i), pa.binary())], names)

    return run


def _remover(window: int, names: list[str]):
    """Cuts the words under ``__found`` and counts them; what stays between cuts is unchanged, runs are joined by a newline."""
    import re

    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = _texts(batch), batch.column("__found").to_pylist()
            kept, total, removed, spans = [], [], [], []
            for text, ranges in zip(texts, found):
                cuts: list[list[int]] = []
                for r in sorted((r["start"], r["start"] + r["n"] + window - 1) for r in ranges or ()):
                    if cuts and r[0] <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], r[1])
                    else:
                        cuts.append(list(r))
                if not cuts:
                    kept.append(text)
                    total.append(len((text or b"").split()))
                else:
                    at = [m.span() for m in word.finditer(text)]
                    edges = [0, *(x for c in cuts for x in c), len(at)]
                    runs = [text[at[a][0] : at[b - 1][1]] for a, b in zip(edges[::2], edges[1::2]) if a < b]
                    kept.append(b"\n".join(runs))
                    total.append(len(at))
                removed.append(sum(b - a for a, b in cuts))
                spans.append([{"start": a, "end": b} for a, b in cuts])
            columns = [pa.array(kept, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in names]
            more = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*names, "n_words", "n_removed", "spans"])

    return run


def _compacted(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (anchor, hash, doc, mark, start, n) of ``shared`` nodes (the same columns): nonbranching paths by their head; and the
    table of heads, which they are read from."""
    node, to = ["anchor", "hash"], ["to_anchor", "to_hash"]
    held = stored(shared.groupBy(*node).agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")), "nodes")
    after = shared.select(F.col("doc").alias("d"), F.col("mark").alias("m"), F.col("start").alias("at"), *[F.col(x).alias(y) for x, y in zip(node, to)])
    steps = shared.join(after, (F.col("doc") == F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("start") + F.col("n") == F.col("at")))
    edges = stored(steps.groupBy(*node, *to).agg(F.count(F.lit(1)).alias("c")), "steps")
    # As often as both of its ends: in- and out-degree are one there.
    straight = edges.join(held, [*node, "c"]).join(held.select(*[F.col(x).alias(y) for x, y in zip(node, to)], "c"), [*to, "c"])
    back = stored(straight.select(*[F.col(y).alias(x) for x, y in zip(node, to)], F.col("anchor").alias("head_anchor"), F.col("hash").alias("head_hash"), F.col("n").cast("long").alias("before")), "links")
    while True:
        up = back.select(F.col("anchor").alias("head_anchor"), F.col("hash").alias("head_hash"), F.col("head_anchor").alias("up_anchor"), F.col("head_hash").alias("up_hash"), F.col("before").alias("more"))
        moved = back.drop("moved").join(up, ["head_anchor", "head_hash"], "left")
        older, back = back, stored(moved.select(*node, F.coalesce("up_anchor", "head_anchor").alias("head_anchor"), F.coalesce("up_hash", "head_hash").alias("head_hash"), (F.col("before") + F.coalesce("more", F.lit(0))).alias("before"), F.col("up_anchor").isNotNull().alias("moved")), "links")
        free(older)
        if back.where("moved").isEmpty():
            break
    free(held, edges)
    placed = shared.join(back.drop("moved"), node, "left")
    head = [F.coalesce("head_anchor", "anchor").alias("anchor"), F.coalesce("head_hash", "hash").alias("hash")]
    placed = placed.select(*head, "doc", "mark", (F.col("start") - F.coalesce("before", F.lit(0))).cast("int").alias("start"), "n")
    return placed.groupBy(*node, "doc", "mark", "start").agg(F.sum("n").cast("int").alias("n")), back


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) without repeated passages, with n_words, n_removed and spans.

    A word goes if a window of ``window`` consecutive words covers it whose words also stand, in this order, in a document
    with a smaller doc_id; windows are judged on the input. ``spans`` lists the cut words (start, end), ``text`` is what
    stays: unchanged where nothing goes, else the kept stretches joined by a newline. Null text has no words and stays null.
    A null doc_id is smaller than none and larger than none: such rows stay whole and cut nothing elsewhere. Rows of one
    doc_id never cut each other. Columns named n_words, n_removed or spans are replaced; an empty table stays empty.
    """
    if not 0 < anchor <= window:
        raise ValueError("anchor must be between 1 and window")
    docs = docs.drop("n_words", "n_removed", "spans")
    names = docs.columns
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    seen = keyed.where("doc is not null and row.text is not null").select("doc", "mark", F.col("row.text").alias("text"))
    paths = stored(seen.mapInArrow(_paths(window, anchor), _PATHS), "paths")

    # Sums are stored before they are joined back: both sides of the join are then plain shuffles, which AQE splits where hot.
    twice = stored(paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "anchors")
    repeated = stored(paths.join(twice, "anchor", "left_semi"), "repeated")
    free(paths, twice)
    first = stored(repeated.groupBy("anchor", "hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "first")
    branching = stored(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "branching")
    judged = stored(repeated.join(first, ["anchor", "hash"]), "judged")
    free(repeated, first)
    # Rows repeated as a whole count once, or they would look like more holders.
    shared = stored(judged.where("first < last").select("anchor", "hash", "doc", "mark", "start", "n").distinct(), "shared")
    whole, heads = _compacted(shared)
    forks = judged.where("first = doc").join(branching, "anchor", "left_semi")
    forks = forks.select(F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("long").alias("hash"), "doc", "mark", "start", "n")

    def by_row(ranges: DataFrame, name: str, *columns: str) -> DataFrame:
        listed = ranges.groupBy("doc", "mark").agg(F.collect_set(F.struct(*columns)).alias(name))
        return listed.select(F.col("doc").alias("d"), F.col("mark").alias("m"), name)

    same = (F.col("doc") == F.col("d")) & (F.col("mark") == F.col("m"))
    ranges = by_row(whole.unionByName(forks), "__ranges", "anchor", "hash", "start", "n")
    # An inner join: texts without any range go no further.
    there = seen.join(ranges.hint("shuffle_hash"), same).select("doc", "mark", "text", "__ranges")
    windows = stored(there.mapInArrow(_windows(window, anchor), _WINDOWS), "windows")
    free(judged, branching, shared, heads)
    name = ["anchor", "hash", "n", "words"]
    least = windows.groupBy(*name).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    least = stored(least.select(F.col("anchor").alias("a"), F.col("hash").alias("h"), F.col("n").alias("k"), F.col("words").alias("w"), "first"), "least")
    equal = (F.col("anchor") == F.col("a")) & (F.col("hash") == F.col("h")) & (F.col("n") == F.col("k")) & F.col("words").eqNullSafe(F.col("w"))
    later = windows.join(least, equal).where("first < doc").select("doc", "mark", "start", "n")
    found = by_row(later, "__found", "start", "n")
    out = keyed.join(found.hint("shuffle_hash"), same, "left").select(*[F.col("row").getField(c).alias(c) for c in names], "__found")
    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
    schema = T.StructType(docs.schema.fields + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(span))])
    return out.mapInArrow(_remover(window, names), schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


SQL = {
    "op2_substring_dedup": rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, i, sha256(array_to_string(ws[i : i + {WINDOW - 1}], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w)),
f as (select h, min(doc_id) as first from g group by h),
c as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as p from g join f using (h) where first < doc_id),
r as (select doc_id, list(p) as ps from c group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(len(ps), 0) as n_removed,
  sha256(array_to_string(case when ps is null then ws else (select coalesce(list(x order by j), []) from (select unnest(ws) as x, unnest(range(1, len(ws) + 1)) as j) where not list_contains(ps, j)) end, ' ')) as kept_sha256
from w left join r on w.doc_id = r.doc_id
"""
}
