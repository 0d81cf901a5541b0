"""Postings by impact: the best matches of a query without reading those that can't be among them.

A posting's impact is its number of positions. Postings lie in tiers of powers of two of it (partitions), by buckets of lexemes,
sorted by lexeme and falling impact, so that a least impact prunes folders by their tier and row groups by their statistics.

No chunk scores more than 0.1 * k times its least impact over the k lexemes of a query: two covers that start with the same
lexeme share no hit, so a hit of the rarest lexeme lies in at most k covers, each of 0.1 or less (one lexeme: exactly 0.1 a hit).
A search ranks the highest tiers that could hold enough matches; their last score gives the least impact that can matter, and a
second read has all postings from there on. Of these, queries of two words or more first combine thin columns: a posting's zones
(a bit for every 8 positions) give the least span of a cover and so a bound of the score. Positions are joined, shuffled and
scored only for chunks whose bound reaches the last score of the likeliest ones; they are read wherever a row group has any.
Nothing is approximated: the result is that of a full scan.

Changes are segments: an update writes its postings and the ids that they replace, and is visible once its commit is there.
``merge`` makes one segment of all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import Conflict, InvalidRequest
from lodestone.operators import fulltext
from lodestone.session import written

BUCKETS = 16
#: The highest tier: impacts of 2 ** TOP_TIER and more.
TOP_TIER = 10
#: Positions of a zone; a posting's zones are bits of a long, position by position and, in longer texts, round again.
ZONE = 8
_ZONES = f"aggregate(positions, 0L, (s, p) -> s | shiftleft(1L, cast(p div {ZONE} % 64 as int)))"
#: Windows that are tried reach this many zones beyond their first: each is two of the one before.
_REACH = [0, 1, 3, 7, 15, 31]
_POSTINGS = "chunk_id string, lexeme string, positions array<int>, n int, zones long, segment int, tier int, bucket int"


@dataclass(frozen=True)
class Found:
    """A search's ``hits`` (chunk_id, score); the chunks whose positions were joined (chunk_id, bound; None: all that were read);
    how many postings its lexemes have, and how many lie in the tiers that were read. Retired chunks are counted."""

    hits: DataFrame
    among: DataFrame | None
    postings: int
    read: int


def _tier_of(n: int) -> int:
    return min(TOP_TIER, int(math.log2(n)))


def _tier(n: Column) -> Column:
    return F.least(F.floor(F.log2(n)), F.lit(TOP_TIER)).cast("int")


class ImpactIndex(fulltext.Ranked):
    """Segments of postings at ``path``. Writers claim a segment each; one that commits after a later segment is refused
    (``Conflict``) and runs again."""

    def __init__(self, spark: SparkSession, path: str, *, stem: bool = False, buckets: int = BUCKETS):
        self.spark, self.path, self.stem, self.buckets = spark, path, stem, buckets

    # --- segments ---

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[tuple[int, int]]:
        """(segment, the first segment that it leaves in use) of every commit, oldest first."""
        at, fs = self._fs(f"{self.path}/_commits")
        return sorted(tuple(map(int, s.getPath().getName().split("-"))) for s in fs.listStatus(at)) if fs.exists(at) else []

    def segments(self) -> list[int]:
        """The segments in use."""
        found = self.commits()
        return [s for s, _ in found if s >= found[-1][1]] if found else []

    def _write(self, segment: int, postings: DataFrame, gone: DataFrame | None, first: int) -> None:
        rows = postings.select("chunk_id", "lexeme", "positions", F.pmod(F.xxhash64("lexeme"), F.lit(self.buckets)).cast("int").alias("bucket"))
        # Large buckets, a frequent lexeme's too, are split over tasks and files, small ones share them; what follows from the
        # positions isn't shuffled.
        dealt = rows.hint("rebalance", F.col("bucket")).withColumn("n", F.size("positions")).where("n > 0").withColumn("zones", F.expr(_ZONES)).withColumn("tier", _tier(F.col("n")))
        at = f"{self.path}/postings/segment={segment}"
        dealt.sortWithinPartitions("tier", "bucket", "lexeme", F.desc("n")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("tier", "bucket").parquet(at)
        stored = self.spark.read.schema("lexeme string, tier int, bucket int").parquet(at)
        counts = stored.groupBy("bucket", "lexeme", "tier").agg(F.count(F.lit(1)).alias("n"))
        counts.repartition("bucket").sortWithinPartitions("lexeme").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/counts/segment={segment}")
        if gone is not None:
            gone.select("chunk_id").distinct().write.mode("overwrite").parquet(f"{self.path}/gone/segment={segment}")
        if any(s >= segment for s, _ in self.commits()):
            raise Conflict("another writer has committed a later segment", segment=segment)
        at, fs = self._fs(f"{self.path}/_commits/{segment:08d}-{first:08d}")
        fs.createNewFile(at)

    def _claim(self) -> int:
        """A number that no writer has had, those that failed included."""
        at, fs = self._fs(f"{self.path}/_claims")
        segment = max([int(s.getPath().getName()) for s in fs.listStatus(at)], default=0) + 1 if fs.exists(at) else 1
        if not fs.createNewFile(self._fs(f"{self.path}/_claims/{segment:08d}")[0]):
            raise Conflict("another writer has claimed this segment", segment=segment)
        return segment

    def add(self, postings: DataFrame, gone: DataFrame | None = None) -> int:
        """Writes a segment of ``postings`` (chunk_id, lexeme, positions); chunks of ``gone`` (chunk_id) leave all earlier ones.
        Updated chunks are in both. Returns the segment's number."""
        found = self.commits()
        segment = self._claim()
        self._write(segment, postings, gone, found[-1][1] if found else segment)
        return segment

    def merge(self) -> int:
        """Makes one segment of what is live; what it replaces stays until ``vacuum``, as searches may still read it."""
        if not self.commits():
            raise InvalidRequest("nothing to merge")
        segment = self._claim()
        self._write(segment, self.live(), None, segment)
        return segment

    def vacuum(self) -> None:
        """Deletes the segments that no search uses any more."""
        used = set(self.segments())
        for kind in ("postings", "counts", "gone"):
            for s, _ in self.commits():
                at, fs = self._fs(f"{self.path}/{kind}/segment={s}")
                if s not in used and fs.exists(at):
                    fs.delete(at, True)

    # --- reading ---

    def live(self, lexemes: list[str] | None = None, least: int = 1) -> DataFrame:
        """Postings in use, of ``lexemes`` and of an impact of ``least`` or more."""
        used = self.segments()
        if not used:
            return self.spark.createDataFrame([], _POSTINGS)
        paths = [f"{self.path}/postings/segment={s}" for s in used]
        rows = self.spark.read.schema(_POSTINGS).option("basePath", f"{self.path}/postings").parquet(*paths)
        rows = rows.where((F.col("tier") >= _tier_of(least)) & (F.col("n") >= least))
        if lexemes is not None:
            rows = rows.where(self._of(lexemes))
        retired = [f"{self.path}/gone/segment={s}" for s in used if (at := self._fs(f"{self.path}/gone/segment={s}"))[1].exists(at[0])]
        if retired:
            last = self.spark.read.schema("chunk_id string, segment int").option("basePath", f"{self.path}/gone").parquet(*retired).groupBy("chunk_id").agg(F.max("segment").alias("until"))
            dead = last.withColumnRenamed("chunk_id", "__id")
            rows = rows.join(dead, (F.col("chunk_id") == F.col("__id")) & (F.col("segment") < F.col("until")), "left_anti")
        return rows

    def _of(self, lexemes: list[str]) -> Column:
        from xxhash import xxh64_intdigest

        signed = [h - (1 << 64) if (h := xxh64_intdigest(x.encode(), 42)) >> 63 else h for x in lexemes]
        return F.col("bucket").isin(*sorted({h % self.buckets for h in signed})) & F.col("lexeme").isin(*lexemes)

    def counts(self, lexemes: list[str]) -> dict[str, dict[int, int]]:
        """Postings by lexeme and tier, those of retired chunks included: at most a row for each tier of each lexeme."""
        found: dict[str, dict[int, int]] = {x: {} for x in lexemes}
        if lexemes and (used := self.segments()):
            rows = self.spark.read.schema("lexeme string, tier int, n long, segment int, bucket int").option("basePath", f"{self.path}/counts").parquet(*[f"{self.path}/counts/segment={s}" for s in used])
            for r in rows.where(self._of(lexemes)).groupBy("lexeme", "tier").agg(F.sum("n").alias("n")).collect():
                found[r["lexeme"]][r["tier"]] = r["n"]
        return found

    def _ranked(self, lexemes: list[str], least: int, limit: int, among: DataFrame | None = None) -> DataFrame:
        rows = self.live(lexemes, least)
        rows = rows if among is None else rows.join(among.select("chunk_id"), "chunk_id", "left_semi")
        hits = fulltext.match(fulltext.Postings(rows, self.stem), lexemes)
        scored = hits.select("chunk_id", fulltext.cover_density(F.col("hits"), len(lexemes)).alias("score"))
        return scored.orderBy(F.desc("score"), "chunk_id").limit(limit)

    def _bounds(self, lexemes: list[str], least: int) -> DataFrame:
        """(chunk_id, bound) of chunks with all ``lexemes``: no score is above its bound. Zones and impacts alone are combined."""
        rows, k = self.live(lexemes, least).select("chunk_id", "n", F.col("zones").alias("w0")), len(lexemes)
        for i in range(len(_REACH) - 1):  # bit z: a hit in one of the zones z .. z + reach
            rows = rows.withColumn(f"w{i + 1}", F.col(f"w{i}").bitwiseOR(F.shiftrightunsigned(f"w{i}", 2**i)).bitwiseOR(F.shiftleft(f"w{i}", 64 - 2**i)))
        met = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.sum("n").alias("hits"), *[F.bit_and(f"w{i}").alias(f"w{i}") for i in range(len(_REACH))]).where(F.col("c") == k)
        # No window of reach + 1 zones has all lexemes: every cover spans more than reach * ZONE.
        span = F.greatest(F.lit(k - 1), *[F.when(F.col(f"w{i}") == 0, F.lit(r * ZONE + 1)).otherwise(F.lit(1)) for i, r in enumerate(_REACH)])
        inside = F.lit(1) if k == 2 else F.col("hits") - 1  # hits of a cover after its first, at most
        return met.select("chunk_id", (0.1 * k * F.col("least") / (1 + F.greatest(F.lit(0), span - inside))).alias("bound"))

    def find(self, query: str, limit: int) -> Found:
        """The best matches, with what was read for them."""
        lexemes = fulltext.query_lexemes(query, stem=self.stem)
        counts = self.counts(lexemes)
        total = sum(n for by in counts.values() for n in by.values())
        above = lambda x, t: sum(n for tier, n in counts[x].items() if tier >= t)
        if not lexemes or not all(counts.values()) or limit < 1:
            return Found(self.spark.createDataFrame([], "chunk_id string, score double"), None, total, 0)
        first = next((t for t in range(TOP_TIER, 0, -1) if all(above(x, t) >= limit for x in lexemes)), 0)
        need, last = 1, 0.0
        if first:
            scores = [r["score"] for r in self._ranked(lexemes, 2**first, limit).collect()]
            if len(scores) == limit:
                last = scores[-1]
                need = max(1, math.ceil(last / (0.1 * (len(lexemes) if len(lexemes) > 1 else 1)) - 1e-6))  # equal scores are read too: ids decide between them
        read = sum(above(x, min(first, _tier_of(need))) for x in lexemes)
        if len(lexemes) == 1:
            return Found(self._ranked(lexemes, need, limit), None, total, read)
        bounds = written(self._bounds(lexemes, need))
        likely = bounds.orderBy(F.desc("bound"), "chunk_id").limit(limit)
        scores = [r["score"] for r in self._ranked(lexemes, need, limit, likely).collect()]
        last = max(last, scores[-1] if len(scores) == limit else 0.0)
        among = bounds.where(F.col("bound") >= last - 1e-9)
        return Found(self._ranked(lexemes, need, limit, among), among, total, read)

    def top(self, query: str, limit: int) -> DataFrame:
        """(chunk_id, score): what :func:`fulltext.search` gives over the live postings."""
        return self.find(query, limit).hits
