"""SimHash near-dedup with pigeonhole blocks.

Fingerprints are 64-bit majorities over the XXH64 of a text's shingles. Two fingerprints within K bits agree on all but K of
any B blocks, so they share the key of some choice of B - K blocks: keys are joined, the Hamming distance is then checked. B
grows with the number of distinct fingerprints, so that keys stay selective and candidates linear in the input.

Copies share a fingerprint and count once. Many different fingerprints can still share a key: those of large families of
near copies. A key is held by at most CROWD fingerprints, or its holders are linked without looking at pairs: fingerprints
within 3 bits have a point of the Hamming cube within 1 bit of one and 2 bits of the other. All crowded fingerprints meet at
the points within 1 bit of them (links of up to 2 bits); those outside the largest component that this gives then also
visit all points within 2 bits, where they meet what is 3 bits away. Points link to their least holder, so rows are linear
in the fingerprints, and no link is lost: of two fingerprints that are 3 bits apart, both lie in the largest component, or
one of them visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import minhash
from lodestone.llm._common import components, small_batches, stored, with_component

SHINGLE = 3
BITS = 3
#: Up to so many fingerprints of a key are compared with each other.
CROWD = 64
#: Words of which shingles are hashed at once.
STRETCH = 50_000


def _fingerprints(shingle: int, names: list[str]):
    """Adds ``fp`` (long) to each row."""
    upper = bytes(range(256)).lower()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        def counts(hashes: list[int], sizes: list[int]):
            """How many hashes of each text set each bit."""
            bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            return np.add.reduceat(bits, np.cumsum([0, *sizes[:-1]]), axis=0, dtype=np.int64)

        def majority(ones, n):
            return np.packbits(2 * ones > n[:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = np.zeros(len(texts), np.uint64)
            rows, sizes, hashes = [], [], []

            def flush() -> None:
                if rows:
                    out[rows] = majority(counts(hashes, sizes), np.array(sizes))
                    rows.clear(), sizes.clear(), hashes.clear()

            for row, text in enumerate(texts):
                words = (text or b"").translate(upper).split()
                if not words:
                    continue
                n = max(1, len(words) - shingle + 1)
                if n > STRETCH:  # a very long text: its counts are added up stretch by stretch
                    ones = np.zeros(64, np.int64)
                    for at in range(0, n, STRETCH):
                        own = words[at : min(at + STRETCH, n) + shingle - 1]
                        own = [xxh64_intdigest(b" ".join(s), 42) for s in zip(*(own[k:] for k in range(shingle)))]
                        ones += counts(own, [len(own)])[0]
                    out[row] = majority(ones[None, :], np.array([n]))[0]
                    continue
                if len(words) < shingle:
                    hashes.append(xxh64_intdigest(b" ".join(words), 42))
                else:
                    hashes += [xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(shingle)))]
                rows.append(row)
                sizes.append(n)
                if len(hashes) > STRETCH:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out.view(np.int64))], [*names, "fp"])

    return run


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (else all columns) with ``fp``: of lower-cased (A-Z) whole texts; no words, or null, give 0.

    Texts of fewer words than a shingle are one shingle. A bit is set if over half the shingles, repeats included, set it.
    """
    names = keep if keep is not None else [c for c in docs.columns if c != "fp"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], *([] if "text" in names else ["text"]))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("fp", T.LongType())])
    return rows.mapInArrow(_fingerprints(shingle, names), schema)


def _block_keys(blocks: int, bits: int):
    """For each choice of blocks that may all agree: (number, mask) of the key."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    keys = [(i, sum(c)) for i, c in enumerate(combinations(masks, blocks - bits))]
    return [(i, m - (1 << 64) if m >> 63 else m) for i, m in keys]


def _near(bits: int):
    """Links within groups of at most CROWD fingerprints: (a, b) that differ in at most ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            a, b = [], []
            for group in batch.column("fps"):
                x = np.sort(group.values.to_numpy())
                u = x.view(np.uint64)  # counting bits of a signed number would count those of its absolute value
                i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= bits, 1))
                a.append(x[i]), b.append(x[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _visits(bits: int):
    """(point, fp) for all points within 1 bit (``wide`` false) or 2 bits of a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
        near = flips
        if bits == 2:
            i, j = np.triu_indices(64, 1)
            near = np.concatenate([flips, flips[1 + i] ^ flips[1 + j]])
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), max(1, 65_536 // len(near))):
                own = fps[at : at + max(1, 65_536 // len(near))]
                points = (own[:, None] ^ near[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(np.repeat(own, len(near)).view(np.int64))], ["point", "fp"])

    return run


def _crowd_links(crowd: DataFrame) -> DataFrame:
    """Exact connectivity of crowded fingerprints at 3 bits, as links (a, b)."""
    points = "point long, fp long"
    one = stored(crowd.mapInArrow(_visits(1), points), "points")
    # Stored before it is joined back: both sides are then plain shuffles, which AQE splits where a point is hot.
    low = stored(one.groupBy("point").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")), "low")
    links = stored(one.join(low.where("n > 1").hint("merge"), "point").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct(), "links")
    roots = stored(components(links), "roots")
    largest = roots.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1).collect()
    most = largest[0]["root"] if largest else None
    outside = crowd.join(roots.where(F.col("root") == F.lit(most).cast("long")).select(F.col("node").alias("fp")).hint("merge"), "fp", "left_anti")
    two = outside.mapInArrow(_visits(2), points)
    far = two.join(low.hint("merge"), "point").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return links.unionByName(far.where("a <> b").distinct())


def link(fps: DataFrame, *, bits: int = BITS, crowd: int = CROWD, blocks: int | None = None) -> DataFrame:
    """(node, root) of every distinct ``fp`` that is within ``bits`` bits of another one: its component's least fingerprint.

    Above ``crowd`` holders of a key the links of at most 3 bits are found as described above, so ``bits`` is 3 at most.
    """
    if not 0 <= bits <= 3:
        raise ValueError("bits must be between 0 and 3")
    distinct = stored(fps.select("fp").distinct(), "fingerprints")
    if blocks is None:
        n = distinct.count()
        # Keys of log2(n) + 2 bits or more, on average: few unrelated fingerprints share one.
        blocks = next(b for b in range(bits + 1, 13) if b == 12 or 64 * (b - bits) // b >= n.bit_length() + 2)
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m")) for i, m in _block_keys(blocks, bits)])
    keys = distinct.withColumn("k", F.explode(masks)).select("fp", F.col("k.i").alias("i"), F.col("fp").bitwiseAND(F.col("k.m")).alias("key"))
    # Counted first: only keys that two or more share go on, and no list is longer than the crowd.
    held = stored(keys.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    # Merged, not broadcast: what the driver would have to hold grows with the input.
    few = keys.join(held.where(F.col("n") <= crowd).hint("merge"), ["i", "key"]).groupBy("i", "key").agg(F.collect_list("fp").alias("fps"))
    links = few.select("fps").mapInArrow(_near(bits), "a long, b long").distinct()
    many = held.where(F.col("n") > crowd)
    if not many.isEmpty():
        if bits != 3:
            raise ValueError("crowded keys are linked at 3 bits")
        links = links.unionByName(_crowd_links(stored(keys.join(many.hint("merge"), ["i", "key"]).select("fp").distinct(), "crowd")))
    return components(links)


def near_duplicates(docs: DataFrame, *, shingle: int | None = None, bits: int = BITS, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of each row: the smallest doc_id that links reach; with ``similarity`` n_shingles, not fp.

    Without ``similarity`` fingerprints of at most ``bits`` differing bits link (``shingle`` words, by default 3). With it,
    texts link whose sets of ``shingle`` words (by default 5) have that Jaccard similarity or more. Fingerprints of these
    shingles, linked in the same way, give groups, in which full sets are compared first. At 0.8 some 10 of 64 bits differ,
    more than blocks of a fingerprint can find: blocks of minima find what is left (see ``minhash``).

    Documents without words share a fingerprint and are linked like any other; with ``similarity`` they link with nothing. A
    null doc_id is linked but names no component (null if all in one are null). Repeated rows are kept. An empty table gives
    an empty one.
    """
    if similarity is not None:
        width = shingle or minhash.SHINGLE
        return minhash.near_duplicates(
            docs,
            shingle=width,
            similarity=similarity,
            fingerprints=lambda texts: fingerprints(texts, shingle=width).withColumnRenamed("fp", "bits"),
            near=lambda fps: link(fps, bits=bits),
        )
    rows = fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle=shingle or SHINGLE, keep=["doc_id"])
    with small_batches(docs.sparkSession):
        rows = stored(rows, "rows")
        roots = stored(link(rows, bits=bits), "roots")
    return with_component(rows, roots)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
