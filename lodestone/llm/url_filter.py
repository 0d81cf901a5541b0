"""URL filters as a sort-merge range join.

A host and its subdomains share the prefix of the reversed host (``com.example.``), so that each rule's host covers one
interval of the sorted keys, and any two intervals nest or are apart. Urls and rules are dealt into ranges of keys and
sorted; one sweep over each range keeps the stack of hosts that are open at the current key, with the rules of each.

* A rule whose interval runs over several ranges is sent to each of them; beyond one copy of every rule, that is at most
  the rules of a range boundary's own parent domains for each boundary.
* Boundaries come from a bounded sample of keys (they decide balance alone, never results). A key ends in the path and a
  hash of the row, so that a hot host, even a hot url, is cut like any other stretch of keys.
* Nothing is broadcast, and a task holds one stack: at most one entry for each label of a host.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._common import host_of, partitions, path_of, reversed_host

#: Keys sampled for each range when boundaries are chosen.
SAMPLE_PER_RANGE = 64
_KEY = "__key"


def _range_of(bounds: list[str]):
    @F.pandas_udf("int")
    def at(keys):
        import pandas as pd

        return pd.Series([bisect_right(bounds, k) for k in keys], dtype="int32")

    return at


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, stack = None, []  # stack: (reversed host, its rules by path, the paths' lengths, longest first)
    for batch in batches:
        parts, keys, kinds, paths, verdicts, names = (batch.column(c).to_pylist() for c in ("__part", _KEY, "__kind", "__path", "__verdict", "__rule"))
        take, rule, verdict = [], [], []
        for i, key in enumerate(keys):
            if parts[i] != part:
                part, stack = parts[i], []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kinds[i] == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, by_path, lengths = stack[-1]
                by_path.setdefault(paths[i], (names[i], verdicts[i]))
                if len(paths[i]) not in lengths:
                    lengths.append(len(paths[i]))
                    lengths.sort(reverse=True)
                continue
            best, size, path = (None, None), -1, paths[i]
            for _, by_path, lengths in reversed(stack):  # longest host first, so that it wins a tie
                for n in lengths:
                    if n <= len(path) and (hit := by_path.get(path[:n])):
                        if len(hit[0]) > size:
                            best, size = hit, len(hit[0])
                        break
            take.append(i)
            rule.append(best[0])
            verdict.append(best[1])
        rows = batch.take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [rows.column("__row"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["__row", "rule", "verdict"]
        )


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced, all others stay.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with the rule's; the
    longest fitting rule (host and path, in characters) wins. Of rules of one length the one with the longer host wins, of
    equal rules with different verdicts the alphabetically last verdict (``block`` before ``allow``). Rules with a null
    column or an empty host fit nothing. A url that no rule fits gets ``default`` and a null rule; so does a null url, or
    one without ``://``, with empty host and path. Repeated rows are judged each; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    n = ranges or partitions(spark)
    pages = pages.drop(*({"host", "path", "rule", "verdict"} - {url}))
    kind = T.StructType(pages.schema.fields)
    # A row's own values salt its key: the same on every attempt, and different for the rows of a hot url.
    own = [c for c, t in pages.dtypes if "map<" not in t and t not in ("variant", "void")]
    salt = F.hex(F.xxhash64(*own))
    split = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("__row"), host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"), salt.alias("__salt"))
    urls = split.select("__row", "__path", F.concat(reversed_host(F.col("__host")), F.lit("\0"), "__path", F.lit("\0"), "__salt").alias(_KEY))

    wanted = SAMPLE_PER_RANGE * n
    share = min(1.0, 1.2 * wanted / max(pages.count(), 1))
    keys = split.select(F.concat(reversed_host(F.col("__host")), F.lit("\0"), F.substring("__path", 1, 64), F.lit("\0"), "__salt"))
    sample = sorted(r[0] for r in (keys.sample(share, seed=7) if share < 1 else keys).limit(2 * wanted).collect())
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    at = _range_of(bounds)

    known = rules.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("h"), F.col("path").alias("__path"), F.col("verdict").alias("__verdict"))
    known = known.where("h <> '' and __path is not null and __verdict is not null").withColumn(_KEY, reversed_host(F.col("h")))
    known = known.withColumn("__part", F.explode(F.sequence(at(F.col(_KEY)), at(F.concat(_KEY, F.lit("\U0010ffff"))))))
    known = known.select("__part", _KEY, F.lit(0).alias("__kind"), "__path", "__verdict", F.concat("h", "__path").alias("__rule"), F.lit(None).cast(kind).alias("__row"))
    rows = urls.select(at(F.col(_KEY)).alias("__part"), _KEY, F.lit(1).alias("__kind"), "__path", F.lit(None).cast("string").alias("__verdict"), F.lit(None).cast("string").alias("__rule"), "__row")
    dealt = known.unionByName(rows).repartitionById(n, F.col("__part")).sortWithinPartitions("__part", _KEY, "__kind", F.desc("__verdict"))
    swept = dealt.mapInArrow(_sweep, T.StructType().add("__row", kind).add("rule", "string").add("verdict", "string"))
    out = swept.select("__row.*", "rule", "verdict")
    return out.select(*pages.columns, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: Fixed rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = {
    "op1_url_filter": rf"""
with u as (
  select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages
), s as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r(h, p, v) as (values {_RULE_ROWS}), best as (
  select page_id, host, path, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
  from s join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all
)
select s.page_id, s.host, s.path, b.rule, coalesce(b.v, 'allow') as verdict
from s left join (select distinct page_id, host, path, rule, v from best) b on s.page_id is not distinct from b.page_id and s.host = b.host and s.path = b.path
"""
}
