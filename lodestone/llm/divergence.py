"""Source divergence audit: how far the term distributions of a language's sources are apart, by a systolic rotation.

Terms are counted in the tasks that read the texts, partial sums are added up, and a language keeps the terms of enough of its
documents. A source's vector has a probability for every kept term, in whole parts of SCALE; only terms that it has are
stored, all others have one base value. Vectors are cut into shards of some kept terms each, as distances add up over shards,
and sources are dealt into blocks; what a block has in a shard is one compressed payload.

The rotation is a round-robin tournament (the circle method): in each round every block meets one other, so that all have met
after as many rounds as there are others. Blocks are written once, bucketed by where they live, and stay there: a round
shuffles the payloads of the guests only. A meeting evaluates both directions at once, for all sources of both blocks, as whole
numbers; a block also meets itself. Payloads of a few rounds are underway at once, whatever their number.

The terms in which a source exceeds its language are ranked by heaps, one for each payload, of which a window takes the best.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import free, new_folder, partitions, stored

SCALE, SMOOTHING = 1_000_000_000, 5
MIN_DOCS, TOP = 30, 50
#: Sources of a block and terms of a shard, about: a payload has some half a million entries at most.
BLOCK, SHARD = 8, 65_536
#: Rounds whose payloads are underway at once.
ROUNDS = 16
#: Distinct terms that a task holds before it puts out what it has counted.
HELD = 500_000

_TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_COUNT_SQL = "lang string, source string, term string, n long, d long"
_PAYLOAD_SQL = "lang string, shard int, block int, payload binary"
_DISTANCE_SQL = "lang string, a string, b string, f long"
_HEAP_SQL = "lang string, source string, id long, f long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term, and documents that have it, by lang and source: partial sums of a task."""
    import re
    from collections import Counter

    term, lower = re.compile(_TERM), bytes(range(256)).lower()
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 100_000):
                some = terms[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())],
                    ["lang", "source", "term", "n", "d"],
                )
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            own = Counter(term.findall(text.translate(lower)))
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(own)
            d.update(own.keys())
            size += len(n)
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(count + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + SMOOTHING * terms)).cast("long")


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    """A block's rows in a shard, (source, id, p, terms), as one payload; the row of a source without id has its base value."""
    import zlib

    import numpy as np

    source, ids, p = table.column("source").to_pylist(), table.column("id"), table.column("p").to_numpy()
    there = np.array([i is not None for i in ids.to_pylist()], bool)
    names = sorted(set(source), key=lambda s: s.encode())
    number = {s: k for k, s in enumerate(names)}
    row = np.array([number[s] for s in source])
    base = np.zeros(len(names), np.int64)
    base[row[~there]] = p[~there]
    entry = np.array(ids.filter(pa.array(there)).to_pylist(), np.int64)
    order = np.lexsort((entry, row[there]))
    entry, entry_row, entry_p = entry[order], row[there][order].astype(np.int64), p[there][order].astype(np.int64)
    body = zlib.compress(np.concatenate([np.diff(entry, prepend=0), entry_row, entry_p]).astype(np.int64).tobytes(), 1)
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict({"names": [names], "base": [base.tolist()], "terms": [table.column("terms")[0].as_py()], "body": [body]})
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    lang, shard, block = (k.as_py() for k in key)
    return pa.table({"lang": pa.array([lang], pa.string()), "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _opened(payload: bytes):
    """(sources, base values, kept terms of the shard, ids, row and value of each entry)."""
    import zlib

    import numpy as np

    one = pa.ipc.open_stream(payload).read_all().to_pylist()[0]
    diff, row, p = np.frombuffer(zlib.decompress(one["body"]), np.int64).reshape(3, -1)
    return one["names"], np.array(one["base"], np.int64), one["terms"], np.cumsum(diff), row, p


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings (lang, own, guest) to what the shard adds to the distance of each two sources, in both directions."""
    import numpy as np

    def dense(opened, ids):
        _, base, _, own, row, p = opened
        m = np.repeat(base[:, None], len(ids), axis=1)
        m[row, np.searchsorted(ids, own)] = p
        return m

    for batch in batches:
        for lang, x, y in zip(batch.column("lang").to_pylist(), batch.column("own"), batch.column("guest")):
            x, y = _opened(x.as_py()), _opened(y.as_py())
            ids = np.union1d(x[3], y[3])
            rest = np.abs(x[1][:, None] - y[1][None, :]) * (x[2] - len(ids))  # terms that none of both has
            m, k = dense(x, ids), dense(y, ids)
            f = np.stack([np.abs(m - v).sum(axis=1) for v in k], axis=1) + rest
            a, b = np.repeat(x[0], len(y[0])).tolist(), np.tile(y[0], len(x[0])).tolist()
            itself = x[0] == y[0]  # a block that meets itself has both directions already
            rows = [(s, t, v) for s, t, v in zip(a, b, f.ravel().tolist()) if s != t]
            rows += [] if itself else [(t, s, v) for s, t, v in rows]
            if rows:
                a, b, v = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array(a), pa.array(b), pa.array(v, pa.int64())], ["lang", "a", "b", "f"])


def _heaps(top: int):
    """Payloads of p - q, where positive, to the ``top`` best entries of each source: largest first, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from heapq import heappush, heappushpop

        heaps: dict[tuple[str, str], list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), heap in heaps.items():
                f, i = zip(*heap)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), pa.array([source] * len(f)), pa.array([-x for x in i], pa.int64()), pa.array(f, pa.int64())], ["lang", "source", "id", "f"])
            heaps.clear()

        for batch in batches:
            for lang, source, i, f in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "id", "f"))):
                heap = heaps.setdefault((lang, source), [])
                heappush(heap, (f, -i)) if len(heap) < top else heappushpop(heap, (f, -i))
            if len(heaps) * top > HELD:
                yield from out()
        yield from out()

    return run


def _partner(block: Column, round_: Column, blocks: Column) -> Column:
    """Whom a block meets in a round of the circle method; with an odd number the last place is empty."""
    n = blocks + F.pmod(blocks, F.lit(2)) - 1  # the blocks that rotate
    other = F.pmod(2 * round_ - block, n)
    return F.when(block == n, F.pmod(round_, n)).when(other == block, n).otherwise(other).cast("int")


def distances(vectors: DataFrame, sources: DataFrame, shards: DataFrame, *, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(lang, a, b, f): the sum of absolute differences of each two sources of a lang, over all its kept terms.

    ``vectors`` (lang, source, id, shard, p) has the entries, ``sources`` (lang, source, base) every source, and ``shards``
    (lang, shard, terms) how many kept terms each shard has.
    """
    spark = vectors.sparkSession
    dealt = sources.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = stored(sources.join(dealt, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")), "places")
    empty = placed.join(shards, "lang").select("lang", "source", "shard", "block", F.lit(None).cast("long").alias("id"), F.col("base").alias("p"), "terms")
    full = vectors.join(placed.select("lang", "source", "block"), ["lang", "source"]).select("lang", "source", "shard", "block", "id", "p", F.lit(None).cast("long").alias("terms"))
    first = Window.partitionBy("lang", "shard", "block")
    cells = empty.unionByName(full).withColumn("terms", F.max("terms").over(first))
    packed = cells.groupBy("lang", "shard", "block").applyInArrow(_packed, _PAYLOAD_SQL)
    payloads = stored(packed.join(dealt, "lang").select("lang", "shard", "block", "blocks", "payload"), "payloads")
    # Residents are written by where they live and read from there in every round: no exchange on their side.
    name, buckets = f"resident_{uuid.uuid4().hex}", partitions(spark)
    home = payloads.select(F.col("lang").alias("home_lang"), F.col("shard").alias("home_shard"), F.col("block").alias("home"), F.col("payload").alias("own"))
    home.repartition(buckets, "home_lang", "home_shard", "home").write.bucketBy(buckets, "home_lang", "home_shard", "home").option("path", new_folder(spark, name)).saveAsTable(name)
    resident = spark.table(name)
    last = payloads.agg(F.max(F.col("blocks") + F.pmod("blocks", F.lit(2)) - 1)).first()[0] or 0
    found = []
    for start in range(0, last + 1, rounds):
        # Round 0 is a block's meeting with itself; of two that meet, both places host as often.
        r = F.explode(F.sequence(F.lit(start), F.least(F.lit(start + rounds - 1), F.col("blocks") + F.pmod("blocks", F.lit(2)) - 1)))
        guests = payloads.where(F.col("blocks") + F.pmod("blocks", F.lit(2)) - 1 >= start).withColumn("round", r)
        guests = guests.withColumn("host", F.when(F.col("round") == 0, F.col("block")).otherwise(_partner(F.col("block"), F.col("round") - 1, F.col("blocks"))))
        hosted = (F.pmod(F.col("block") + F.col("host"), F.lit(2)) == 0) == (F.col("host") < F.col("block"))
        guests = guests.where((F.col("round") == 0) | ((F.col("host") < F.col("blocks")) & hosted)).select("lang", "shard", "host", F.col("payload").alias("guest"))
        met = guests.join(resident.hint("merge"), (F.col("lang") == F.col("home_lang")) & (F.col("shard") == F.col("home_shard")) & (F.col("host") == F.col("home")))
        sums = met.select("lang", "own", "guest").mapInArrow(_met, _DISTANCE_SQL).groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))
        found.append(stored(sums, "distances"))
    spark.sql(f"drop table {name}")
    free(payloads, placed)
    out = found[0] if found else spark.createDataFrame([], _DISTANCE_SQL)
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a lang all others by distance (part ``pair``), and the
    ``top`` terms in which it exceeds its lang most (part ``term``).

    Null text, lang and source are ''. A term is a run of ASCII letters and characters beyond ASCII, with A-Z lower-cased; a
    lang keeps those in ``min_docs`` of its rows or more (each row is a document, repeated ones too). A lang without kept terms
    has distances of 0, and equal values rank by item. Sources without terms count like any other; a lang of one source has
    no pairs. Other columns don't matter; an empty table gives an empty one.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = rows.mapInArrow(_counted, _COUNT_SQL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    counts = stored(counts, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("lang_n")).where(F.col("d") >= min_docs).drop("d")
    # Numbers of partitions sorted by range follow the terms' UTF-8 order: ties by item are ties by id.
    kept = stored(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("id", F.monotonically_increasing_id()), "kept")
    sizes = stored(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total")), "sizes")
    deal = F.pmod(F.xxhash64("id"), F.ceil(F.col("terms") / shard)).cast("int").alias("shard")
    known = kept.join(sizes, "lang").select("lang", "term", "id", deal, share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    entries = stored(counts.select("lang", "source", "term", "n").join(known, ["lang", "term"]).select("lang", "source", "id", "shard", "n", "q"), "entries")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    sources = stored(sources.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")), "sources")
    vectors = stored(entries.join(sources, ["lang", "source"]).select("lang", "source", "id", "shard", "q", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "vectors")
    free(counts, entries)

    base = sources.where("terms > 0").select("lang", "source", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("base"))
    f = distances(vectors.select("lang", "source", "id", "shard", "p"), base, known.groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("terms")), block=block, rounds=rounds)
    none = sources.where("terms = 0").select("lang", "source")
    apart = none.alias("x").join(none.alias("y"), (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") != F.col("y.source")))
    f = f.unionByName(apart.select("x.lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.lit(0).cast("long").alias("f")))
    by = lambda *order: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), *order))
    pairs = f.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), F.col("f").alias("value")).withColumn("rank", by("item"))

    over = vectors.where("p > q").select("lang", "source", "id", (F.col("p") - F.col("q")).alias("f"))
    best = over.mapInArrow(_heaps(top), _HEAP_SQL).withColumnRenamed("f", "value").withColumn("rank", by("id")).where(F.col("rank") <= top)
    best = best.join(kept.select("id", "term"), "id").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(best)


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


SQL = {
    "op12_divergence": r"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by all having count(distinct rid) >= 30),
groups as (select distinct lang, source from d),
v as (select g.lang, count(term) as v from (select distinct lang from d) g left join kept k on k.lang = g.lang group by all),
n as (select lang, source, term, count(*) as c from w semi join kept using (lang, term) group by all),
p as (select g.lang, g.source, k.term, coalesce(c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 5)) // (coalesce(sum(c) over (partition by g.lang, g.source), 0) + 5 * v) as p
  from groups g join kept k on k.lang = g.lang join v on v.lang = g.lang left join n on n.lang = g.lang and n.source = g.source and n.term = k.term),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(c) + 5)) // (sum(sum(c)) over (partition by lang) + 5 * any_value(v)) as q from p join v using (lang) group by lang, term),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast(p - q as bigint) as value from p join q using (lang, term) where c > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 50
"""
}
