"""Indexes by hashed terms: substrings of names by trigrams, contained JSON by paths and values.

Both hold postings (term, id): a row has every term that what it contains has. A query reads the postings of its rarest terms,
keeps the ids that have all of these (relational division), and tests the rows themselves, so the result is that of a scan. A
query without terms (a name of two letters, an empty object) scans.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.errors import InvalidRequest
from lodestone.operators import filters
from lodestone.session import written

BUCKETS = 64
#: Terms of a query that are intersected: more read more and rule out little.
RAREST = 3
#: Queries of a batch that have no terms and are held against all rows.
MAX_SCANNED = 1_000


class TermIndex:
    """Postings at ``path`` by buckets of their terms, with the number of ids of each term."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "string", buckets: int = BUCKETS):
        self.spark, self.path, self.id_type, self.buckets = spark, path, id_type, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.col("term"), F.lit(self.buckets)).cast("int").alias("bucket")

    def write(self, rows: DataFrame) -> TermIndex:
        """Writes (term, id). A frequent term's ids are spread over several tasks and files."""
        every = rows.select("term", "id").distinct().withColumn("bucket", self._bucket())
        dealt = every.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(4)))
        dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/postings")
        counted = self.postings().groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("n"))
        counted.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/counts")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"term long, id {self.id_type}, bucket int").parquet(f"{self.path}/postings")

    def counts(self) -> DataFrame:
        return self.spark.read.schema("term long, n long, bucket int").parquet(f"{self.path}/counts")

    def having(self, terms: list[int]) -> DataFrame:
        """(id) of rows that have the rarest of ``terms``: the counts of all of them are looked up, a row for each."""
        at = lambda ts: F.col("bucket").isin(*sorted({t % self.buckets for t in ts})) & F.col("term").isin(*ts)
        known = {r["term"]: r["n"] for r in self.counts().where(at(terms)).collect()}
        chosen = sorted(set(terms), key=lambda t: (known.get(t, 0), t))[:RAREST]
        rows = self.postings()
        if known.get(chosen[0], 0) == 0:
            return rows.where(F.lit(False)).select("id")
        return rows.where(at(chosen)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(chosen)).select("id")

    def having_many(self, wants: DataFrame, rarest: int = RAREST) -> DataFrame:
        """(query, id) for the rows (query, term) of many queries at once; a query's terms are ranked by what they read.

        With ``rarest`` 1 the postings of a query's rarest term are its candidates: nothing is intersected, so nothing is grouped."""
        asked = wants.select("query", "term").distinct().withColumn("bucket", self._bucket())
        n = F.coalesce("n", F.lit(0))
        ranked = asked.join(self.counts(), ["bucket", "term"], "left").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(n, "term")))
        chosen = ranked.where(F.col("r") <= rarest).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("query")))
        met = self.postings().join(chosen.select("query", "bucket", "term", "k"), ["bucket", "term"])
        if rarest == 1:
            return met.select("query", "id")
        return met.groupBy("query", "id").agg(F.count(F.lit(1)).alias("c"), F.first("k").alias("k")).where("c = k").select("query", "id")


# --- substrings ----------------------------------------------------------------------------------------------------------


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text; none if it is shorter or null."""
    at = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(3))))


def _pieces(term: Column) -> Column:
    """The literal stretches of a LIKE term: ``%`` and ``_`` part them, a backslash makes the next character literal."""
    return F.transform(F.regexp_extract_all(term, F.lit(r"((?:\\.|[^%_\\])+)"), F.lit(1)), lambda p: F.regexp_replace(p, r"\\(.)", "$1"))


def _grams(term: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(_pieces(F.lower(term)), trigrams)))


class SubstringIndex:
    """``LIKE '%term%'`` on the name or display name of ``entities`` (id, name, display_name), without regard to case."""

    def __init__(self, entities: DataFrame, index: TermIndex):
        self.entities, self.index = entities, index

    @classmethod
    def write(cls, entities: DataFrame, path: str) -> SubstringIndex:
        # Both names' trigrams are one set: the test of the rows tells them apart.
        both = F.array_union(*[F.coalesce(trigrams(F.lower(c)), F.array().cast("array<string>")) for c in ("name", "display_name")])
        rows = entities.select("id", F.explode(both).alias("g")).select(F.xxhash64("g").alias("term"), "id")
        return cls(entities, TermIndex(entities.sparkSession, path, entities.schema["id"].dataType.simpleString()).write(rows))

    def candidates(self, term: str) -> DataFrame | None:
        """(id) of what may match, or None if the term has no trigrams."""
        found = self.entities.sparkSession.range(1).select(F.explode(_grams(F.lit(term))).alias("g")).select(F.xxhash64("g")).collect()
        return self.index.having([r[0] for r in found]) if found else None

    def seeds(self, term: str, limit: int = 10) -> DataFrame:
        """What ``graph.seeds`` finds, by the index."""
        from lodestone.operators import graph

        near = self.candidates(term)
        return graph.seeds(self.entities if near is None else self.entities.join(near, "id", "left_semi"), term, limit)

    def match_many(self, terms: DataFrame) -> DataFrame:
        """(term, id) of all matches of distinct ``terms`` (term). Those without trigrams, at most MAX_SCANNED, meet every row."""
        terms = terms.where("term is not null").select("term").distinct().withColumn("g", _grams(F.col("term")))
        terms = written(terms)
        short = [r["term"] for r in terms.where(F.size("g") == 0).select("term").limit(MAX_SCANNED + 1).collect()]
        if len(short) > MAX_SCANNED:
            raise InvalidRequest(f"more than {MAX_SCANNED} terms without three letters in a row")
        names = self.entities.select("id", "name", "display_name")

        def like(term: Column) -> Column:
            pattern = F.concat(F.lit("%"), F.lower(term), F.lit("%"))
            return F.coalesce(F.call_function("like", F.lower("name"), pattern), F.lit(False)) | F.coalesce(F.call_function("like", F.lower("display_name"), pattern), F.lit(False))

        near = self.index.having_many(terms.select(F.col("term").alias("query"), F.explode("g").alias("g")).select("query", F.xxhash64("g").alias("term")), rarest=1)
        found = near.join(names, "id").where(like(F.col("query"))).select(F.col("query").alias("term"), "id")
        if short:
            every = F.filter(F.array(*map(F.lit, short)), like)
            found = found.unionByName(names.select(F.explode(every).alias("term"), "id"))
        return found


# --- paths and values ----------------------------------------------------------------------------------------------------

#: Levels of nesting that are indexed; deeper parts are left to the test of the rows.
DEPTH = 8


def _key(path: Column, value: Column) -> Column:
    return F.xxhash64(path, value)


def json_terms(rows: DataFrame, column: str) -> DataFrame:
    """(term, id): a term for every scalar of a row's JSON with its path. Array elements have one path, whatever their place;
    malformed and null JSON has none. All levels are one pass: a generator opens what is open and hands scalars on."""
    spark = rows.sparkSession
    level = rows.select("id", F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("v")).where("v is not null")
    for _ in range(DEPTH):
        inner = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).toDF("pos", "key", "value"))
        # A length before the key: no two paths are written alike. Without a position there was nothing to open.
        step = F.when(F.col("key").isNull(), F.lit("[]")).otherwise(F.concat(F.lit("."), F.length("key"), F.lit(":"), F.col("key")))
        closed = F.col("pos").isNull()
        level = inner.select("id", F.when(closed, F.col("path")).otherwise(F.concat("path", step)).alias("path"), F.when(closed, F.col("v")).otherwise(F.col("value")).alias("v"))
    kind = F.schema_of_variant("v")
    return level.where(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")).select(_key(F.col("path"), F.to_json("v")).alias("term"), "id")


def _leaves(want: Any, path: str = "$", depth: int = 0) -> list[tuple[str, str]]:
    if depth > DEPTH:
        return []
    if isinstance(want, Mapping):
        return [x for k, v in want.items() for x in _leaves(v, f"{path}.{len(k)}:{k}", depth + 1)]
    if isinstance(want, list):
        return [x for v in want for x in _leaves(v, f"{path}[]", depth + 1)]
    return [(path, json.dumps(want, ensure_ascii=False))]


class PathIndex:
    """JSON containment on ``column`` of ``rows`` (id, ...), by postings of paths and values."""

    def __init__(self, rows: DataFrame, column: str, index: TermIndex):
        self.rows, self.column, self.index = rows, column, index

    @classmethod
    def write(cls, rows: DataFrame, column: str, path: str) -> PathIndex:
        return cls(rows, column, TermIndex(rows.sparkSession, path, rows.schema["id"].dataType.simpleString()).write(json_terms(rows, column)))

    def candidates(self, want: Mapping[str, Any]) -> DataFrame | None:
        """(id) of what may contain ``want``, or None if it has no scalars."""
        if not (leaves := _leaves(want)):
            return None
        got = self.index.spark.range(1).select(F.array(*[_key(F.lit(p), F.lit(v)) for p, v in leaves])).first()[0]
        return self.index.having(got)

    def containing(self, want: Mapping[str, Any]) -> DataFrame:
        """The rows that contain ``want``, as ``filters.metadata_contains`` with ``nested`` decides; no want is no filter."""
        if not want:
            return self.rows
        near = self.candidates(want)
        rows = self.rows if near is None else self.rows.join(near, "id", "left_semi")
        return rows.where(filters.metadata_contains(self.column, want, nested=True))
