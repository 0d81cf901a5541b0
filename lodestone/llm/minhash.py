"""Near-duplicates by the Jaccard similarity of word shingles: circulant MinHash finds candidates, the full sets decide.

Circulant MinHash (Li and Li, 2021) takes two permutations of the universe, here of 32-bit hashes: the first, sigma, breaks up
what structure the elements have; the second, pi, shifted circularly by k, gives coordinate k of every signature as the
minimum of pi(sigma(x) + k). So a signature of any length needs two permutations, not one for each coordinate. Both are
invertible mixings of 32-bit numbers, so they are permutations indeed and minima tie for equal elements only.

Bands of ROWS coordinates are keys; their number follows from the similarity, so that a pair of exactly this similarity
shares none with a probability of MISS at most. Sets that share a key go on if one byte of their coordinates agrees in as many
places as five standard deviations below the expected number, and are then compared as full sets of 64-bit hashes, with whole
numbers. Texts with equal sets count once.

A key that at most CROWD sets hold is compared in full. Larger ones, as families of near copies have, go another way:

1. An exact bound thins them. A shingle that no other set of such keys has is never common to two, so sets of sizes n and m
   with u and v such shingles have at most min(n - u, m - v) in common. Sets that by this reach no other holder of the key
   need not be compared.
2. The set with the least share of such shingles leads its key, and all holders are compared with it: for copies of one text
   this links nearly all that link at all. Then a set outside the key's largest component leads once more.
3. What is still outside the largest component of a key is compared with all its holders, block by block, a product of two
   incidence matrices each. A block gives a link for each component that a set of it reaches, never all pairs.

Groups that another method finds near, as ``simhash`` does by fingerprints, may come first: each set of a group is compared in
full with the group's least, and two sets that this links are in one component, so keys needn't compare them again.

Sides of joins grow with the corpus, so none is broadcast, however small it is.

So no pair across components stays uncompared, families take rows linear in their size, and a key of n unlike texts that may
all have a partner by the bound takes n * n comparisons (no rows), spread over its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import components, free, small_batches, stored, with_component

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 5
#: A pair at the threshold has no key in common with this probability at most.
MISS = 1e-5
#: Up to so many sets of a key are compared with each other as pairs.
CROWD = 8
#: How often a set leads a larger key before blocks are compared.
LEADS = 2
#: Sets of a block, and bytes of their shingles, about.
BLOCK, BLOCK_BYTES = 256, 1 << 21
#: Shingles that are hashed at once, words whose hashes a task keeps, and columns of an incidence matrix.
STRETCH, KNOWN, COLUMNS = 100_000, 200_000, 4096

_SET_SQL = "doc_id long, mark long, bits long, fp long, size long, keys array<long>, sketch binary"
_PAIR_SQL = "a long, b long"


def bands(similarity: float) -> int:
    """Keys of ROWS coordinates that a pair of ``similarity`` needs for a miss of MISS at most."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


def _agree(similarity: float) -> int:
    """Places of the sketch in which a pair of ``similarity`` agrees at least, but for five standard deviations."""
    n = bands(similarity) * ROWS
    return math.floor(n * similarity - 5 * math.sqrt(n * similarity * (1 - similarity)))


def _mixed(x, first: int, second: int, by: int):
    """A permutation of 32-bit numbers: each step can be undone."""
    import numpy as np

    x = x * np.uint32(first)
    x ^= x >> np.uint32(by)
    x *= np.uint32(second)
    x ^= x >> np.uint32(15)
    return x


def signature(shingles, starts, length: int):
    """Circulant signatures (a row for each of ``starts``) of 64-bit shingle hashes, ``length`` coordinates each."""
    import numpy as np

    sigma = _mixed((shingles >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35, 13)
    out = np.empty((len(starts), length), np.uint32)
    for k in range(length):
        out[:, k] = np.minimum.reduceat(_mixed(sigma + np.uint32(k), 0x9E3779B1, 0x7FEB352D, 16), starts)
    return out


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = h = xxh64_intdigest(word, 42)
        return h


_LOWER = bytes(range(256)).lower()


def _shingles(text: bytes | None, shingle: int, known: _Words):
    """Sorted distinct 64-bit hashes of a text's shingles; of fewer words than that, one of the whole sequence."""
    import numpy as np

    if len(known) > KNOWN:
        known.clear()
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    own = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        own *= np.uint64(0x9E3779B97F4A7C15)
        own += h[k : len(h) - width + 1 + k]
    own ^= own >> np.uint64(29)
    own *= np.uint64(0xBF58476D1CE4E5B9 + 2 * width)
    own ^= own >> np.uint64(32)
    return np.unique(own)


def _sets(shingle: int, similarity: float):
    """doc_id, mark, bits and text to the set of shingles: its id, size, band keys and a byte of each coordinate."""
    count = bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        known = _Words()

        def flush(ids: list, marks: list, bits: list, sets: list) -> pa.RecordBatch:
            held = [k for k, s in enumerate(sets) if len(s)]
            keys, sketch = [[] for _ in sets], [b""] * len(sets)
            if held:
                least = signature(np.concatenate([sets[k] for k in held]), np.cumsum([0, *(len(sets[k]) for k in held[:-1])]), count * ROWS)
                key = np.tile(np.arange(1, count + 1, dtype=np.uint64), (len(held), 1))
                for r in range(ROWS):
                    key = (key ^ least[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                for k, own, low in zip(held, key.view(np.int64), (least & np.uint32(255)).astype(np.uint8)):
                    keys[k], sketch[k] = own, low.tobytes()
            fps = np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(bits, pa.int64()), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "mark", "bits", "fp", "size", "keys", "sketch"],
            )

        for batch in batches:
            ids, marks, bits, sets, n = [], [], [], [], 0
            for doc, mark, own, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "bits")), batch.column("text").cast(pa.binary()).to_pylist()):
                ids.append(doc), marks.append(mark), bits.append(own), sets.append(_shingles(text, shingle, known))
                n += len(sets[-1])
                if n > STRETCH:
                    yield flush(ids, marks, bits, sets)
                    ids, marks, bits, sets, n = [], [], [], [], 0
            if ids:
                yield flush(ids, marks, bits, sets)

    return run


def _full_sets(shingle: int):
    """(fp, grams) of (fp, text): the set as bytes of sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                grams = [_shingles(t, shingle, known).tobytes() for t in some.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("fp"), pa.array(grams, pa.binary())], ["fp", "grams"])

    return run


def _alike(similarity: float):
    """The sets of one key (at most CROWD) to pairs (a < b) of different roots whose sketches agree enough."""
    enough, least = _agree(similarity), Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            low, high = [], []
            for own in batch.column("own"):
                group = own.values
                fp, size, root = (group.field(c).to_numpy() for c in ("fp", "size", "root"))
                sketch = np.frombuffer(b"".join(group.field("sketch").to_pylist()), np.uint8).reshape(len(group), -1)
                i, j = np.triu_indices(len(fp), 1)
                fits = (root[i] != root[j]) & (np.minimum(size[i], size[j]) * least.denominator >= np.maximum(size[i], size[j]) * least.numerator) & ((sketch[i] == sketch[j]).sum(axis=1) >= enough)
                low.append(np.minimum(fp[i], fp[j])[fits]), high.append(np.maximum(fp[i], fp[j])[fits])
            if low:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], ["a", "b"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, fp) for each shingle of each set."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            own = [np.frombuffer(g, np.int64) for g in some.column("grams").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.repeat(some.column("fp").to_numpy(), [len(g) for g in own]))], ["gram", "fp"])


def _compared(similarity: float):
    """Pairs with both full sets to those whose Jaccard similarity is ``similarity`` or more, in whole numbers."""
    least = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                both = np.concatenate([np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common * least.denominator >= least.numerator * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _met(similarity: float):
    """Two blocks of a key's sets to links (a, b) of ``similarity`` or more: for each set of the first and each component of
    the second that it isn't in, one link at most."""
    least = Fraction(str(similarity))

    def common(own: list, others: list):
        """How many shingles each two have in common: products of incidence matrices, some columns at a time."""
        import numpy as np

        flat = [np.concatenate(s) for s in (own, others)]
        row = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (own, others)]
        shared = np.intersect1d(*flat)
        out = np.zeros((len(own), len(others)), np.int64)
        place = [np.searchsorted(shared, f) for f in flat]
        there = [(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == f) if len(shared) else np.zeros(len(f), bool) for p, f in zip(place, flat)]
        row, place = [r[t] for r, t in zip(row, there)], [p[t] for p, t in zip(place, there)]
        for at in range(0, len(shared), COLUMNS):
            m = []
            for s, r, p in zip((own, others), row, place):
                some = (p >= at) & (p < at + COLUMNS)
                m.append(np.zeros((len(s), min(COLUMNS, len(shared) - at)), np.float32))
                m[-1][r[some], p[some] - at] = 1
            out += (m[0] @ m[1].T).astype(np.int64)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for own, others in zip(batch.column("own"), batch.column("others")):
                (x, xr, xs), (y, yr, ys) = ((g.field("fp").to_numpy(), g.field("root").to_numpy(), [np.frombuffer(b, np.uint64) for b in g.field("grams").to_pylist()]) for g in (own.values, others.values))
                both = common(xs, ys)
                union = np.array([len(s) for s in xs])[:, None] + np.array([len(s) for s in ys])[None, :] - both
                i, j = np.nonzero((both * least.denominator >= least.numerator * union) & (xr[:, None] != yr[None, :]))
                _, one = np.unique(np.stack([i, yr[j]]), axis=1, return_index=True)
                if len(one):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i[one]]), pa.array(y[j[one]])], ["a", "b"])

    return run


def _may_pair(many: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of ``many`` (key, fp, size) the rows that, by the bound on what is common, may reach ``similarity`` with a holder of
    their key; with ``free``, the number of shingles that another set has too."""
    crowd = sets.join(many.select("fp").distinct(), "fp", "left_semi").select("fp", "grams")
    alone = crowd.mapInArrow(_grams, "gram long, fp long").groupBy("gram").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("c")).where("c = 1")
    alone = stored(alone.groupBy("fp").agg(F.count(F.lit(1)).alias("alone")), "alone")
    marked = stored(many.join(alone, "fp", "left").withColumn("free", F.col("size") - F.coalesce("alone", F.lit(0))).drop("alone"), "many")
    # Sizes in steps of two percent: a key has a few hundred of them at most.
    sizes = marked.groupBy("key", F.floor(F.log("size") * 50).alias("step")).agg(F.min("size").alias("least"), F.max("free").alias("most"))
    sizes = stored(sizes.select(F.col("key").alias("k"), "least", "most"), "sizes")
    enough = F.least("free", "most") >= F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("least")) - 1e-9
    out = stored(marked.join(sizes.hint("merge"), (F.col("key") == F.col("k")) & enough, "left_semi"), "may")
    free(alone, marked, sizes)
    return out


def _block(count: Column, total: Column) -> Column:
    """Of how many blocks a key's sets make: by their number and by their bytes."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(total * 8 / BLOCK_BYTES)).cast("int")


def _blocks_met(now: DataFrame, outside: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of ``outside`` (key, fp) to any holder in ``now`` (key, fp, root, size) of their key, by blocks of both."""
    apart = outside.groupBy("key").agg(F.count(F.lit(1)).alias("own_n"))
    keys = now.join(apart.hint("merge"), "key").groupBy("key").agg(F.first("own_n").alias("own_n"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    keys = keys.select("key", _block(F.col("n"), F.col("total")).alias("blocks"), F.ceil(F.col("own_n") / F.col("n") * _block(F.col("n"), F.col("total"))).cast("int").alias("own_blocks"))
    keys = stored(keys, "keys")
    rows = stored(now.join(keys.hint("merge"), "key").join(sets.hint("merge"), "fp"), "rows")
    entry = F.struct("fp", "root", "grams")
    others = rows.groupBy("key", F.pmod(F.xxhash64("fp", F.lit(7)), "blocks").cast("int").alias("block")).agg(F.collect_list(entry).alias("others"))
    own = rows.join(outside.hint("merge"), ["key", "fp"], "left_semi").groupBy("key", F.pmod(F.xxhash64("fp", F.lit(5)), "own_blocks").alias("part")).agg(F.first("blocks").alias("blocks"), F.collect_list(entry).alias("own"))
    others, own = stored(others, "others"), stored(own, "own")
    # A block of sets outside meets each block of the key: in a task of its own, wherever the key is.
    met = own.select("key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(others.hint("merge"), ["key", "block"])
    links = stored(met.select("own", "others").mapInArrow(_met(similarity), _PAIR_SQL), "links")
    free(keys, rows, others, own)
    return links


def link(once: DataFrame, texts: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD, near: DataFrame | None = None) -> DataFrame:
    """(node, root) of every set that a chain of pairs of ``similarity`` or more links.

    ``once`` has a row for each set (fp, size, keys, sketch, doc_id, mark); ``texts`` (doc_id, mark, text) has their texts:
    only those whose set shares a key with another one, or stands in ``near``, are shingled again. ``near`` (a, b; a < b) has
    pairs that are compared first.
    """
    keys = once.select("fp", F.explode("keys").alias("key"))
    held = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "held")
    members = stored(keys.join(held.hint("merge"), "key"), "members")
    some = members.select("fp")
    if near is not None:
        some = some.unionByName(near.select(F.explode(F.array("a", "b")).alias("fp")))
    wanted = stored(once.join(some.distinct().hint("merge"), "fp", "left_semi").select("fp", "size", "sketch", F.col("doc_id").alias("d"), F.col("mark").alias("m")), "wanted")
    full = texts.join(wanted.select("fp", "d", "m").hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("fp", "text").mapInArrow(_full_sets(shingle), "fp long, grams binary")
    sets = stored(full.groupBy("fp").agg(F.first("grams").alias("grams")), "sets")  # repeated rows have one set
    marked = marked_at = stored(members.join(wanted.select("fp", "size", "sketch").hint("merge"), "fp"), "marked")
    free(held, members, wanted)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.distinct(), "pairs")
        grams = lambda end, name: sets.select(F.col("fp").alias(end), F.col("grams").alias(name))
        found = stored(pairs.join(grams("a", "x").hint("merge"), "a").join(grams("b", "y").hint("merge"), "b").mapInArrow(_compared(similarity), _PAIR_SQL), "links")
        free(pairs)
        return found

    def rooted(part: DataFrame, links: DataFrame) -> DataFrame:
        roots = stored(components(links), "roots")
        named = roots.select(F.col("node").alias("fp"), "root")
        out = stored(part.drop("root").join(named.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
        free(roots)
        return out

    def apart(part: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``part`` with its roots by ``links``, and the rows of it outside the largest component of their key."""
        now = rooted(part, links)
        sizes = now.groupBy("key", F.col("root").alias("most")).agg(F.count(F.lit(1)).alias("c"))
        largest = stored(sizes.groupBy("key").agg(F.max_by("most", F.struct("c", "most")).alias("most")), "largest")
        outside = stored(now.join(largest.hint("merge"), "key").where("root <> most").select("key", "fp", "size", "free"), "outside")
        free(largest)
        return now, outside

    marked = marked.withColumn("root", F.col("fp"))
    known = None
    if near is not None:
        known = verified(near)
        old, marked = marked_at, rooted(marked, known)
        free(old)
        marked_at = marked
    few = marked.where(F.col("n") <= crowd).groupBy("key").agg(F.collect_list(F.struct("fp", "size", "sketch", "root")).alias("own"))
    links = verified(few.select("own").mapInArrow(_alike(similarity), _PAIR_SQL))
    if known is not None:
        links = links.unionByName(known)
    many = marked.where(F.col("n") > crowd).select("key", "fp", "size")
    if not many.isEmpty():
        now, outside = _may_pair(many, sets, similarity), None
        if known is not None:  # what lies in one component by fingerprints needs no leader
            last, (now, outside) = now, apart(now, links)
            free(last)
        for _ in range(LEADS):
            if outside is not None and outside.isEmpty():
                break
            lead = (now if outside is None else outside).groupBy("key").agg(F.max_by("fp", F.struct(F.col("free") / F.col("size"), "fp")).alias("lead"))
            pairs = now.join(lead.hint("merge"), "key").where("fp <> lead").select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b"))
            old, links = links, stored(links.unionByName(verified(pairs)), "links")
            last, led = now, outside
            now, outside = apart(now, links)
            free(old, last, *([] if led is None else [led]))
        if not outside.isEmpty():
            links = links.unionByName(_blocks_met(now.select("key", "fp", "root", "size"), outside.select("key", "fp"), sets, similarity))
    roots = stored(components(links), "roots")
    free(marked_at, sets)
    return roots


def _with_least(once: DataFrame, groups: DataFrame) -> DataFrame:
    """Each set of a group (``groups``: node, root; sets of equal bits are in one) with the group's least: (a, b), a < b."""
    of = once.select("fp", "bits").join(groups.select(F.col("node").alias("bits"), "root").hint("merge"), "bits", "left")
    of = stored(of.select("fp", F.coalesce("root", "bits").alias("root")), "groups")
    # Stored before it is joined back: both sides are then plain shuffles, which AQE splits where a group is large.
    least = stored(of.groupBy("root").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("root", "a"), "least")
    out = stored(of.join(least.hint("merge"), "root").where("fp <> a").select("a", F.col("fp").alias("b")), "near")
    free(of, least)
    return out


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    crowd: int = CROWD,
    fingerprints: Callable[[DataFrame], DataFrame] | None = None,
    near: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the size of its set, and the smallest doc_id that links reach.

    Sets are of distinct shingles of ``shingle`` lower-cased (A-Z) words of the whole text; fewer words are one shingle. Sets
    link whose intersection is ``similarity`` of their union or more, equal ones always. A text without words, or null, has an
    empty set and links with nothing: its row names itself. A null doc_id is linked but names no component (null if all in
    one are null). Repeated rows are kept, and rows of one doc_id with unlike texts may be in two components. Columns other
    than doc_id and text don't matter; an empty table gives an empty one.

    ``fingerprints`` adds ``bits`` to a table (doc_id, mark, text), and ``near`` gives (node, root) of the groups of (fp) that
    these form: both or none. What they put together is compared first; which sets link doesn't depend on them.
    """
    if not 0 < similarity <= 1 or shingle < 1:
        raise ValueError("similarity must be above 0 and at most 1, shingle at least 1")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    with small_batches(docs.sparkSession):
        read = texts.withColumn("bits", F.lit(None).cast("long")) if fingerprints is None else fingerprints(texts)
        rows = stored(read.mapInArrow(_sets(shingle, similarity), _SET_SQL), "rows")
        some = rows.where("size > 0")
        # One row for each set, with the document that it is taken from: partial sums go before the shuffle, so copies do too.
        once = stored(some.groupBy("fp").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.min("bits").alias("bits"), F.min(F.struct("doc_id", "mark")).alias("at")).select("fp", "size", "keys", "sketch", "bits", "at.doc_id", "at.mark"), "once")
        pairs = None if near is None else _with_least(once, near(once.select(F.col("bits").alias("fp"))))
        roots = link(once, texts, shingle=shingle, similarity=similarity, crowd=crowd, near=pairs)
        thin = stored(rows.select("doc_id", "fp", "size"), "thin")
        free(rows, once)
    linked = with_component(thin.where("size > 0"), roots)
    out = linked.select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return out.unionByName(thin.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, similarity=0.85).withColumn("kept", F.col("doc_id") == F.col("component_id"))


SQL = {
    "op11_minhash": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select doc_id, case when len(words) = 0 then []::varchar[] when len(words) < 5 then [array_to_string(words, ' ')]
  else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as sh from w),
grams as (select doc_id, unnest(sh) as g from s),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from common join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c >= 85 * (len(x.sh) + len(y.sh) - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from s union select r.a, l.b from reach r join both_ways l on l.a = r.b),
least as (select a, min(b) as component_id from reach group by a)
select doc_id, cast(len(sh) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join least on a = doc_id
"""
}
