"""Exact top-k inner products by norm-bucketed retrieval (after LEMP; Teflioudi, Gemulla, Mykytiuk, 2015).

Vectors are range-sorted by length and packed into buckets of similar length; a bucket is one row with its matrix. Queries
are packed alike. A first round over the longest bucket of each dimension gives every query a threshold; the second deals
groups of buckets to tasks, through which all query blocks stream. For a bucket, a query's local cosine threshold is its
current k-th score over the product of lengths: above 1 the bucket is passed over; where it is high, the coordinate on which
the query is largest bounds the candidates to an interval of a sorted column; else candidates are the prefix of vectors
long enough. What remains is verified with exact products.

Cutting by length and id splits repeated vectors like any others. Scores stay integers: products go through doubles only
where every sum is below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import partitions, stored

#: Vectors in a bucket, queries in a block, buckets in the group that a task holds.
BUCKET, BLOCK, GROUP = 2048, 256, 64
#: Local cosine above which a coordinate's interval is used instead of the length prefix.
COSINE = 0.8

_PACKED = "dim int, part int, nr int, top double, need double, ids binary, values binary, width int, theta binary"
#: Scores of vectors of this length fit 64 bits.
LONGEST = float(1 << 31)


def integer_vectors(rows: DataFrame, *, id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(vec_id, v, norm) with v = floor(scale * x) of rows whose vectors are whole: not null, no null or non-finite component.

    A length of 2**31 or more raises when the row is read: its scores might not fit 64 bits.
    """
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == F.lit(float("inf"))))
    ints = F.transform(x, lambda y: F.floor(y * scale).cast("long"))
    out = rows.where(F.col(id).isNotNull() & x.isNotNull() & ~bad).select(F.col(id).cast("long").alias("vec_id"), ints.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double")))
    wide = F.raise_error(F.concat(F.lit("scores of this vector may not fit 64 bits: "), F.col("vec_id"))).cast("double")
    return out.withColumn("norm", norm).withColumn("norm", F.when(F.col("norm") < LONGEST, F.col("norm")).otherwise(wide))


def _packer(size: int):
    """Sorted (dim, v, vec_id, theta) rows of a partition as one row for each ``size`` of a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, nr, held, dim = TaskContext.get().partitionId(), 0, [], None

        def flush():
            nonlocal nr, held
            ids, vectors, theta = (np.concatenate(x) for x in zip(*held))
            most = int(np.abs(vectors).max(initial=0))
            width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
            norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
            # Of queries: the length that a vector must have to reach any one's threshold.
            need = np.divide(theta - 1e-6, norms * (1 + 1e-9), out=np.full(len(ids), -np.inf), where=(norms > 0) & (theta > -(2**63)))
            row = [dim, part, nr, float(norms.max()), float(need.min()) - 1e-9 * abs(float(need.min())) if np.isfinite(need.min()) else -np.inf, ids.tobytes(), vectors.astype(f"<i{width}").tobytes(), width, theta.tobytes()]
            nr, held = nr + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))], [c.split()[0] for c in _PACKED.split(", ")])

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1), len(dims)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if dim != int(dims[a]) and held:
                    yield flush()
                dim = int(dims[a])
                own = batch.slice(a, b - a)
                ids = own.column("vec_id").to_numpy()
                vectors = own.column("v").flatten().to_numpy().reshape(len(ids), dim)
                theta = own.column("theta").to_numpy()
                while len(ids):
                    room = size - sum(len(h[0]) for h in held)
                    held.append((ids[:room], vectors[:room], theta[:room]))
                    ids, vectors, theta = ids[room:], vectors[room:], theta[room:]
                    if sum(len(h[0]) for h in held) == size:
                        yield flush()
        if held:
            yield flush()

    return run


def _packed(rows: DataFrame, size: int, n: int) -> DataFrame:
    """Longest first; ``theta`` is a score that the query's k-th result has at least."""
    ready = rows.select(F.size("v").alias("dim"), "v", "vec_id", "norm", F.coalesce("theta", F.lit(-(2**63))).cast("long").alias("theta"))
    order = ["dim", F.desc("norm"), "vec_id"]
    return ready.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("norm").mapInArrow(_packer(size), _PACKED)


def _scan(k: int):
    """Buckets (kind 0) of a group are held, blocks (kind 1) stream by: the k best of the group for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        buckets: list[dict] = []
        group = None

        def unpack(row: dict) -> dict:
            v = np.frombuffer(row["values"], f"<i{row['width']}").reshape(-1, row["dim"]) if row["dim"] else np.zeros((len(row["ids"]) // 8, 0), "<i2")
            return {"dim": row["dim"], "ids": np.frombuffer(row["ids"], np.int64), "v": v, "norms": np.sqrt((v.astype(float) ** 2).sum(1)), "theta": np.frombuffer(row["theta"], np.int64).copy(), "columns": {}}

        def products(q, qn, x, xn):
            if qn.max(initial=0) * xn.max(initial=0) * 1.01 < 2**53:
                return (q.astype(float) @ x.astype(float).T).astype(np.int64)
            return q.astype(np.int64) @ x.astype(np.int64).T

        def scan(block: dict) -> pa.RecordBatch | None:
            n = len(block["ids"])
            best = np.empty((0, 3), np.int64)  # query, score, vector
            theta, qn = block["theta"], block["norms"]
            for b in buckets:
                if b["dim"] != block["dim"]:
                    continue
                top = b["norms"][0] if len(b["norms"]) else 0.0
                limit = theta.astype(float)
                reach = qn * top * (1 + 1e-9) + 1e-6
                alive = np.flatnonzero(limit <= reach)
                if not len(alive):
                    continue
                local = np.divide(limit[alive], reach[alive], out=np.zeros(len(alive)), where=reach[alive] > 0)
                sharp = alive[(local > COSINE) & (b["dim"] > 0) & (b["norms"][-1] > 0)]
                flat = np.setdiff1d(alive, sharp)
                found = []
                if len(flat):
                    need = np.divide(limit[flat], qn[flat], out=np.full(len(flat), -np.inf), where=qn[flat] > 0).min()
                    m = int(np.searchsorted(-b["norms"], -(need * (1 - 1e-9) - 1e-6), "right"))
                    s = products(block["v"][flat], qn[flat], b["v"][:m], b["norms"][:m])
                    s[block["ids"][flat][:, None] == b["ids"][None, :m]] = -(2**63)
                    bar = theta[flat]
                    if m > k:
                        bar = np.maximum(bar, np.partition(s, m - k, axis=1)[:, m - k])
                    i, j = np.nonzero((s >= bar[:, None]) & (s > -(2**63)))
                    found.append(np.column_stack([flat[i], s[i, j], b["ids"][j]]))
                for q in sharp:
                    unit = block["v"][q] / qn[q]
                    f = int(np.abs(unit).argmax())
                    if f not in b["columns"]:
                        column = b["v"][:, f] / b["norms"]
                        order = np.argsort(column, kind="stable")
                        b["columns"][f] = order, column[order]
                    order, column = b["columns"][f]
                    c = min(1.0, limit[q] / reach[q])
                    middle, half = unit[f] * c, np.sqrt(max(0.0, (1 - c * c) * (1 - unit[f] ** 2)))
                    # Vectors within the angle of c; the interval ends at 1 or -1 where that axis is within it too.
                    if unit[f] >= 0:
                        low, high = middle - half, 1.0 if unit[f] >= c else middle + half
                    else:
                        low, high = -1.0 if -unit[f] >= c else middle - half, middle + half
                    rows = order[np.searchsorted(column, low - 1e-9) : np.searchsorted(column, high + 1e-9, "right")]
                    s = products(block["v"][q : q + 1], qn[q : q + 1], b["v"][rows], b["norms"][rows])[0]
                    ok = (s >= theta[q]) & (b["ids"][rows] != block["ids"][q])
                    found.append(np.column_stack([np.full(ok.sum(), q), s[ok], b["ids"][rows][ok]]))
                best = np.concatenate([best, *found])
                best = best[np.lexsort((best[:, 2], -best[:, 1], best[:, 0]))]
                first = np.searchsorted(best[:, 0], np.arange(n))
                best = best[np.arange(len(best)) - first[best[:, 0]] < k]
                have = np.bincount(best[:, 0], minlength=n)
                full = np.flatnonzero(have == k)
                last = np.searchsorted(best[:, 0], full, "right") - 1
                theta[full] = np.maximum(theta[full], best[last, 1])
            if len(best):
                return pa.RecordBatch.from_arrays([pa.array(block["ids"][best[:, 0]]), pa.array(best[:, 2].copy()), pa.array(best[:, 1].copy())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    group, buckets = row["group"], []
                if row["kind"] == 0:
                    buckets.append(unpack(row))
                elif (out := scan(unpack(row))) is not None:
                    yield out

    return run


def _search(buckets: DataFrame, blocks: DataFrame, groups: int, k: int) -> DataFrame:
    """``buckets`` with their group; a block goes to the groups whose longest vector can reach one of its thresholds: a stated
    query set against all rows, in blocks."""
    tops = buckets.groupBy("group", "dim").agg(F.max("top").alias("reach")).select("group", F.col("dim").alias("d"), "reach")
    tops = stored(tops, "groups")  # a row for each GROUP * BUCKET vectors
    every = blocks.join(F.broadcast(tops) if groups <= 200_000 else tops, (F.col("dim") == F.col("d")) & (F.col("reach") >= F.col("need"))).drop("d", "reach")
    rows = buckets.withColumn("kind", F.lit(0)).unionByName(every.withColumn("kind", F.lit(1)))
    dealt = rows.repartitionById(groups, F.col("group")).sortWithinPartitions("group", "kind", "dim", F.desc("top"), "part", "nr")
    return dealt.mapInArrow(_scan(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, ties to the smaller vec_id.

    Both tables as integer_vectors() gives them. Every vector but those with the query's own vec_id is a candidate, if of
    the query's dimension; fewer than k give fewer rows. Repeated rows are candidates each; of repeated query ids the
    least vector asks. Empty tables give an empty result.
    """
    n = partitions(vectors.sparkSession)
    asked = stored(queries.groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("x")).select("vec_id", "x.v", "x.norm"), "queries")
    buckets = stored(_packed(vectors.withColumn("theta", F.lit(None).cast("long")), BUCKET, n), "buckets")
    sizes = buckets.groupBy("part").agg((F.floor(F.max("nr") / GROUP) + 1).cast("int").alias("n")).orderBy("part").collect()  # a row for each range
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    offset, groups = {}, 0
    for r in sizes:
        offset[r["part"]], groups = groups, groups + r["n"]
    starts = F.array(*[F.lit(offset.get(p, 0)) for p in range(max(offset) + 1)])
    grouped = buckets.withColumn("group", (F.get(starts, F.col("part")) + F.floor(F.col("nr") / GROUP)).cast("int"))

    longest = buckets.groupBy("dim").agg(F.max(F.struct("top", "part", "nr")).alias("x")).select("dim", "x.part", "x.nr")
    seeds = buckets.join(longest, ["dim", "part", "nr"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    blocks = _packed(asked.withColumn("theta", F.lit(None).cast("long")), BLOCK, n)
    spread = blocks.withColumn("group", F.pmod(F.hash("part", "nr"), F.lit(n)))
    rows = seeds.select(*buckets.columns, "group", F.lit(0).alias("kind")).unionByName(spread.withColumn("kind", F.lit(1)))
    first = rows.repartitionById(n, F.col("group")).sortWithinPartitions("group", "kind", "dim", F.desc("top"), "part", "nr").mapInArrow(_scan(k), "query_id long, vec_id long, score long")
    bar = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("theta"))
    known = asked.join(bar.withColumnRenamed("query_id", "q"), F.col("vec_id") == F.col("q"), "left").select("vec_id", "v", "norm", "theta")
    found = _search(grouped, stored(_packed(known, BLOCK, n), "blocks"), groups, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op10_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


SQL = {
    "op10_topk": """
with v as (select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
}
