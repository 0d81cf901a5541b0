"""A Merkle manifest of a dataset, with proofs by parent-preimage paths.

Rows are hashed to leaves, leaves are numbered within their group by a sort by range, and runs of ``arity`` consecutive nodes
are hashed to their parent until one node is left; the groups' roots then make one more such tree. What is stored of a parent
is its preimage: the concatenated hashes of its children, 64 characters each. A leaf's proof needs nothing else. On its way
to the root it excises its own slot of 64 characters from each preimage, which leaves its siblings, and to be folded it
splices the hash that it has into that slot and hashes the preimage.

Nodes are worked on in chunks of consecutive ones, subtrees of about CHUNK leaves. A chunk's root is a node of the next tier,
so there are as many tiers as CHUNK has powers in the number of leaves, three for a billion, and each is one grouping by chunk:
no level takes a join of all leaves, no group is larger than a chunk, and what a leaf needs from above its chunk is one
short path which all of its chunk share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import free, stored

ARITY = 2
#: About so many nodes make a chunk.
CHUNK = 1024
#: What a leaf is the hash of, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_PATH = "array<struct<preimage:string,slot:int>>"
_TIER_SQL = "grp string, chunk long, root string, levels array<string>"
_PROOF_SQL = "doc_id long, grp string, leaf string, proof_sha256 string, folded string"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) of the fields: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _height(arity: int) -> int:
    """Levels of a full chunk."""
    n = 1
    while arity ** (n + 1) <= CHUNK:
        n += 1
    return n


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (grp and the columns of ``order``) with ``pos``, from 0 within each grp (null: one of its own), stored.

    Sorted by range and numbered within partitions; where a group starts in a partition comes from a table of one row for each
    partition and group in it. Rows that tie in all of ``order`` are put apart by their place in the stored input.
    """
    base = stored(rows.withColumn("__tie", F.monotonically_increasing_id()), "rows")
    tie = F.xxhash64("__tie")
    sorted_ = base.repartitionByRange("grp", *order, tie).sortWithinPartitions("grp", *order, tie).withColumn("__m", F.monotonically_increasing_id())
    ranked = stored(sorted_, "ranked")
    part = F.shiftright("__m", 33)
    starts = ranked.groupBy(F.col("grp").alias("__g"), part.alias("__p")).agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(starts.withColumn("__before", F.coalesce(before, F.lit(0))), "starts")
    met = ranked.join(starts, F.col("grp").eqNullSafe(F.col("__g")) & (part == F.col("__p")))
    out = stored(met.select(*rows.columns, (F.col("__m") - F.col("__first") + F.col("__before")).alias("pos")), "placed")
    free(base, ranked, starts)
    return out


def _tier(arity: int):
    """Chunks (grp, chunk, whole, hashes in order) to their root and, level by level, the preimages of all parents in a row."""
    from hashlib import sha256

    width, height = 64 * arity, _height(arity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, levels = [], []
            for whole, nodes in zip(batch.column("whole").to_pylist(), batch.column("hashes")):
                level, own = "".join(nodes.values.to_pylist()), []
                # Alone in its group a chunk ends with one node; beside others it has all levels, even of a single node.
                while len(own) < height if not whole else len(level) > 64:
                    own.append(level)
                    level = "".join(sha256(level[at : at + width].encode()).hexdigest() for at in range(0, len(level), width))
                roots.append(level), levels.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("chunk"), pa.array(roots, pa.string()), pa.array(levels, pa.list_(pa.string()))], ["grp", "chunk", "root", "levels"])

    return run


def _own_path(levels: list[str], place: int, arity: int) -> list[tuple[str, int]]:
    """(preimage, slot) of a chunk's node at ``place``, upwards."""
    width, out = 64 * arity, []
    for level in levels:
        out.append((level[place // arity * width : (place // arity + 1) * width], place % arity))
        place //= arity
    return out


def _paths(arity: int):
    """Chunks with the path above them to the path above each of their nodes: (grp, chunk, path), the node being a chunk."""
    size = arity ** _height(arity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("preimage", pa.string()), ("slot", pa.int32())]))
        for batch in batches:
            for grp, chunk, count, levels, above in zip(*(batch.column(c).to_pylist() for c in ("grp", "chunk", "count", "levels", "above"))):
                paths = [[{"preimage": p, "slot": s} for p, s in _own_path(levels, k, arity)] + above for k in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array([grp] * count, pa.string()), pa.array(range(chunk * size, chunk * size + count), pa.int64()), pa.array(paths, kind)], ["grp", "chunk", "path"])

    return run


def _proofs(arity: int):
    """Chunks of leaves with the path above them to each leaf's proof and the root that its present hash folds to."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grp, levels, above = (batch.column(c)[k].as_py() for c in ("grp", "levels", "above"))
                leaves = batch.column("leaves")[k].values
                ids, hashes, now = (leaves.field(c).to_pylist() for c in ("doc_id", "leaf", "now"))
                upper = [(p["preimage"], 64 * p["slot"]) for p in above]
                rest = "".join(p[:s] + p[s + 64 :] for p, s in upper)
                proofs, folded = [], []
                for place, h in enumerate(now):
                    own = [(p, 64 * s) for p, s in _own_path(levels, place, arity)]
                    proofs.append(sha256(("".join(p[:s] + p[s + 64 :] for p, s in own) + rest).encode()).hexdigest())
                    for p, s in own + upper:
                        h = sha256((p[:s] + h + p[s + 64 :]).encode()).hexdigest()
                    folded.append(h)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([grp] * len(ids), pa.string()), pa.array(hashes, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string())], ["doc_id", "grp", "leaf", "proof_sha256", "folded"])

    return run


@dataclass(frozen=True)
class Tree:
    """Trees over groups of nodes (grp, pos, hash). ``tiers`` (grp, chunk, count, root, levels), lowest first: the stored
    preimages; ``roots`` (grp, root)."""

    tiers: list[DataFrame]
    roots: DataFrame
    arity: int

    def above(self, top: DataFrame | None = None) -> DataFrame:
        """(grp, chunk, path) of the lowest tier's chunks: (preimage, slot) of each level above a chunk's root. ``top``
        (grp, path) goes on above the trees' roots."""
        path = self.tiers[-1].select("grp", "chunk")
        given = F.array().cast(_PATH)
        if top is None:
            path = path.withColumn("path", given)
        else:
            t = top.select(F.col("grp").alias("__g"), "path")
            path = path.join(t, F.col("grp").eqNullSafe(F.col("__g")), "left").select("grp", "chunk", F.coalesce("path", given).alias("path"))
        for tier in self.tiers[:0:-1]:
            p = path.select(F.col("grp").alias("__g"), F.col("chunk").alias("__c"), F.col("path").alias("above"))
            met = tier.join(p, F.col("grp").eqNullSafe(F.col("__g")) & (F.col("chunk") == F.col("__c"))).select("grp", "chunk", "count", "levels", "above")
            path = stored(met.mapInArrow(_paths(self.arity), f"grp string, chunk long, path {_PATH}"), "paths")
        return path


def tree(nodes: DataFrame, arity: int = ARITY) -> Tree:
    """The trees of ``nodes`` (grp, pos, hash): tier by tier, until every group has one chunk."""
    if not 2 <= arity <= CHUNK:
        raise ValueError(f"arity must be between 2 and {CHUNK}")
    size, tiers = arity ** _height(arity), []
    while True:
        chunk = F.floor(F.col("pos") / size).cast("long")
        many = nodes.groupBy(F.col("grp").alias("__g")).agg((F.max("pos") < size).alias("whole"))
        grouped = nodes.groupBy("grp", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).getField("hash").alias("hashes"))
        rows = grouped.join(many, F.col("grp").eqNullSafe(F.col("__g"))).select("grp", "chunk", "whole", "hashes")
        made = stored(rows.mapInArrow(_tier(arity), _TIER_SQL), "tier")
        counts = nodes.groupBy(F.col("grp").alias("__g"), chunk.alias("__c")).agg(F.count(F.lit(1)).cast("int").alias("count"))
        tiers.append(stored(made.join(counts, F.col("grp").eqNullSafe(F.col("__g")) & (F.col("chunk") == F.col("__c"))).select("grp", "chunk", "count", "root", "levels"), "tier"))
        free(made)
        nodes = tiers[-1].select("grp", F.col("chunk").alias("pos"), F.col("root").alias("hash"))
        if nodes.where("pos > 0").isEmpty():
            return Tree(tiers, tiers[-1].select("grp", "root"), arity)
        # A group that is done goes on as a group of one node, which stays what it is.


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (doc_id, grp, pos, leaf, now) with the hash each row has at present; the trees below and above the groups' roots."""

    leaves: DataFrame
    below: Tree
    #: The groups in order: (grp, pos, hash).
    groups: DataFrame
    top: Tree

    def write(self, path: str) -> None:
        """All preimages as Parquet below ``path``: (tree, tier, grp, chunk, count, root, levels)."""
        for name, t in (("below", self.below), ("top", self.top)):
            for k, tier in enumerate(t.tiers):
                tier.withColumns({"tree": F.lit(name), "tier": F.lit(k)}).write.mode("append").parquet(path)

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf."""
        arity = self.below.arity
        up = self.top.above()
        tier = self.top.tiers[0].join(up.select(F.col("chunk").alias("__c"), F.col("path").alias("above")), F.col("chunk") == F.col("__c"))
        paths = tier.select(F.lit(None).cast("string").alias("grp"), "chunk", "count", "levels", "above").mapInArrow(_paths(arity), f"grp string, chunk long, path {_PATH}")
        named = stored(self.groups.select("grp", "pos", F.col("hash").alias("subroot")).join(paths.select(F.col("chunk").alias("pos"), "path"), "pos"), "groups")
        above = self.below.above(named)
        size = arity ** _height(arity)
        entry = F.struct("pos", "doc_id", "leaf", "now")
        chunks = self.leaves.groupBy("grp", F.floor(F.col("pos") / size).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list(entry)).alias("leaves"))
        same = lambda a, b: F.col(f"{a}.grp").eqNullSafe(F.col(f"{b}.grp")) & (F.col(f"{a}.chunk") == F.col(f"{b}.chunk"))
        met = chunks.alias("c").join(self.below.tiers[0].alias("t"), same("c", "t")).join(above.alias("u"), same("c", "u"))
        met = met.select("c.grp", "c.leaves", "t.levels", F.col("u.path").alias("above"))
        made = met.mapInArrow(_proofs(arity), _PROOF_SQL).alias("p")
        root = F.lit(next((r["root"] for r in self.top.roots.take(1)), None)).cast("string")
        out = made.join(named.select("grp", "subroot").alias("n"), F.col("p.grp").eqNullSafe(F.col("n.grp")))
        return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def manifest(docs: DataFrame, *, now: dict[str, Column] | None = None, arity: int = ARITY) -> Manifest:
    """The manifest of ``docs`` (FIELDS and any other columns): a leaf for each row, a tree for each ``lang``, one above.

    ``now`` replaces columns by what they hold at present, for the hashes that are folded against the manifest. Leaves stand in
    the order of doc_id, null first; rows of one doc_id in that of their hashes, repeated rows are leaves of their own. Groups
    stand in the order of lang, null first, by UTF-8 bytes. Every field may be null, an empty text is not null. An empty
    table has no rows, groups or root. Other columns don't matter.
    """
    wide = docs.select(*[F.col(f).cast("long" if f in ("doc_id", "n_chars") else "string").alias(f) for f in FIELDS])
    changed = [(now or {}).get(f, F.col(f)) for f in FIELDS]
    thin = wide.select("doc_id", F.col("lang").alias("grp"), leaf_hash(*[F.col(f) for f in FIELDS]).alias("leaf"), leaf_hash(*changed).alias("now"))
    leaves = placed(thin, ["doc_id", "leaf", "now"])
    below = tree(leaves.select("grp", "pos", F.col("leaf").alias("hash")), arity)
    one = F.lit(None).cast("string")
    groups = placed(below.roots.select(one.alias("grp"), F.col("grp").alias("name"), F.col("root").alias("hash")), ["name"])
    top = tree(groups.select("grp", "pos", "hash"), arity)
    return Manifest(leaves, below, groups.select(F.col("name").alias("grp"), "pos", "hash"), top)


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(docs, now={"n_chars": tampered}).proofs()


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v}))::varchar || ':' || {v}, '-')" for v in ("s", "source", "lang", f"({n_chars})::varchar", "text")) + ")"


_LEVEL = "select lvl + 1, g, x.pos // 2, sha256(string_agg(h, '' order by x.pos)), (c + 1) // 2 from {t} x where c > 1 group by lvl, g, x.pos // 2, c"
_STEP = """select w.rid, w.lvl + 1, w.g, w.pos // 2, (w.c + 1) // 2, sha256(case when s.h is null then w.h when w.pos % 2 = 0 then w.h || s.h else s.h || w.h end), w.proof || coalesce(s.h, '')
  from {w} w left join {t} s on s.lvl = w.lvl and s.g = w.g and s.pos = xor(w.pos, 1) where w.c > 1"""
SQL = {
    "op13_merkle": f"""
with recursive d as (select row_number() over () as rid, *, doc_id::varchar as s from documents),
crc as (select rid, xor(list_reduce(list_prepend(4294967295::bigint, range(8 * length(s))), lambda c, k: xor((case when k % 8 = 0 then xor(c, ascii(substr(s, (k // 8 + 1)::int, 1))::bigint) else c end) >> 1,
  case when (case when k % 8 = 0 then xor(c, ascii(substr(s, (k // 8 + 1)::int, 1))::bigint) else c end) & 1 = 1 then 3988292384::bigint else 0::bigint end)), 4294967295::bigint) as crc from d where s is not null),
l as (select rid, doc_id, lang, {_leaf_sql("n_chars")} as leaf, {_leaf_sql("n_chars + case when crc % 7 = 0 then 1 else 0 end")} as now from d left join crc using (rid)),
p as (select *, dense_rank() over (order by lang nulls first) - 1 as g, row_number() over (partition by lang order by doc_id nulls first, leaf, now) - 1 as pos, count(*) over (partition by lang) as c from l),
t as (select 0 as lvl, g, pos, leaf as h, c from p union all {_LEVEL.format(t="t")}),
r as (select g, h as subroot from t where c = 1),
u as (select 0 as lvl, 0::bigint as g, g as pos, subroot as h, (select count(*) from r) as c from r union all {_LEVEL.format(t="u")}),
a as (select rid, 0 as lvl, g, pos, c, now as h, '' as proof from p union all {_STEP.format(w="a", t="t")}),
b as (select rid, 0 as lvl, 0::bigint as g, g as pos, (select count(*) from r) as c, h, proof from a where c = 1 union all {_STEP.format(w="b", t="u")})
select p.doc_id, p.leaf, r.subroot, u.h as root, sha256(b.proof) as proof_sha256, b.h as folded_root, b.h = u.h as verified
from p join r using (g) join b using (rid) join u on u.c = 1 where b.c = 1
"""
}
