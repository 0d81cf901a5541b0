"""Quality rules as a learned decision list.

Statistics of every text are Spark expressions on its row: no shuffle, no Python. Rules are learned on the driver from the
statistics of at most MAX_LABELLED labelled documents, by sequential covering: a rule grows by the threshold condition with
the highest information gain, is pruned on rows held back, and joins the list only if it is precise there. A rule has at most
MAX_CONDITIONS conditions and a list at most MAX_RULES rules, so that it can be read. The list becomes one ordered CASE
expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import SPACE

#: Documents that the list is learned from at most: those with the least hashes of their doc_id.
MAX_LABELLED = 20_000
#: A rule is kept if so many of the rows it rejects are bad ones (Laplace estimate, on rows held back): clean ones stay.
MIN_PRECISION = 0.9
MAX_CONDITIONS = 4
MAX_RULES = 16

#: What rules may test, as SQL over the statistics; null for texts without words, which no condition holds for.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "try_divide(word_chars, n_words)",
    "symbol_share": "try_divide(n_symbols, n_words)",
    "dup_lines": "n_dup_lines",
    "repeat_share": "try_divide(n_repeat_words, n_words)",
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


#: One generated row for each text. The nested lambdas bind the words, the sorted windows and the positions of repeated ones,
#: each evaluated once; and no filter on the results can be pushed below a generator, which would evaluate them again.
_STATISTICS = rf"""
inline(transform(array(filter(split({{text}}, '{SPACE.replace(chr(92), chr(92) * 2)}'), x -> x <> '')), w -> named_struct(
  'n_words', cast(size(w) as bigint),
  'word_chars', cast(length(array_join(w, '')) as bigint),
  'n_symbols', cast(length(regexp_replace({{text}}, '[^#*$%&|<>]+', '')) as bigint),
  'n_dup_lines', transform(array(filter(split({{text}}, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')), l -> cast(size(l) - size(array_distinct(l)) as bigint))[0],
  'n_repeat_words', transform(array(
      if(size(w) < 3, array(), sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('h', xxhash64(w[i], w[i + 1], w[i + 2]), 'p', i))))
    ), s -> aggregate(
      sort_array(transform(filter(s, (x, i) -> x.h = get(s, i - 1).h or x.h = get(s, i + 1).h), x -> x.p)),
      named_struct('t', 0L, 'l', -3L), (a, p) -> named_struct('t', a.t + least(3L, p - a.l), 'l', cast(p as bigint)), a -> a.t
    ))[0]
)))
"""


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with STATS and base_failed (columns of these names are replaced). Null text has no words.

    Repeated words are found by sorting a text's own 3-word windows by hash, so the cost is n log n in its length.
    """
    docs = docs.drop(*STATS, "base_failed")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(*kept, F.expr(_STATISTICS.replace("{text}", f"coalesce(`{text}`, '')")))
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions (feature, ``<=`` or ``>``, threshold)."""

    conditions: tuple[tuple[str, str, float], ...]

    def holds(self, row: dict[str, float | None]) -> bool:
        return all((v := row[f]) is not None and (v <= t if op == "<=" else v > t) for f, op, t in self.conditions)

    def column(self, features: dict[str, str]) -> Column:
        tests = [F.coalesce(F.expr(f"{features[f]} {op} {t!r}D"), F.lit(False)) for f, op, t in self.conditions]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.conditions)


def _best_condition(bad: list[dict], good: list[dict], features: list[str]) -> tuple[str, str, float] | None:
    """The threshold with the highest FOIL gain over the rows that a rule covers so far."""
    p0, n0 = len(bad), len(good)
    before, best, found = math.log2(p0 / (p0 + n0)), 1e-9, None
    for f in features:
        rows = sorted([(r[f], 1) for r in bad if r[f] is not None] + [(r[f], 0) for r in good if r[f] is not None])
        total = sum(k for _, k in rows)
        p = n = 0
        for (v, k), (after, _) in zip(rows, rows[1:]):
            p, n = p + k, n + 1 - k
            if v == after:
                continue
            for op, a, b in (("<=", p, n), (">", total - p, len(rows) - total - n)):
                if a and (gain := a * (math.log2(a / (a + b)) - before)) > best:
                    best, found = gain, (f, op, (v + after) / 2)
    return found


def learn_rules(rows: list[tuple[bool, dict[str, float | None]]], features: list[str], *, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """An ordered list of rejecting rules from (is bad, features) rows. Every third row is held back for pruning."""
    held = rows[2::3]
    kept = [r for i, r in enumerate(rows) if i % 3 != 2]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        bad, good = [x for b, x in kept if b], [x for b, x in kept if not b]
        if not bad:
            break
        conditions: list[tuple[str, str, float]] = []
        p, n = bad, good
        while n and len(conditions) < MAX_CONDITIONS and (c := _best_condition(p, n, features)):
            conditions.append(c)
            p, n = ([x for x in side if Rule((c,)).holds(x)] for side in (p, n))
        if not conditions:
            break

        def worth(rule: Rule) -> tuple[float, int]:
            a, b = (sum(1 for bad_, x in held if bad_ == k and rule.holds(x)) for k in (True, False))
            return (a + 1) / (a + b + 2), -len(rule.conditions)

        rule = max((Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)), key=worth)
        if worth(rule)[0] < min_precision:
            break
        rules.append(rule)
        kept = [(b, x) for b, x in kept if not rule.holds(x)]
        held = [(b, x) for b, x in held if not rule.holds(x)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, features: dict[str, str] | None = None) -> list[Rule]:
    """Rules learned from ``labels`` (doc_id, quality: 0 is bad) that pass the base checks; none without labels of both kinds.

    The sample is bounded by ``max_labelled`` and is the only thing that reaches the driver or is broadcast: a row for each
    labelled doc_id, where rows of ``docs`` share one that with the least statistics. doc_id may be of any type.
    """
    features = features or FEATURES
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    some = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("__id"), "__quality")
    known = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id")).where("text is not null")
    values = [F.expr(f"cast({e} as double)").alias(f) for f, e in features.items()]
    table = with_statistics(known).groupBy("doc_id").agg(F.min(F.struct("base_failed", (F.col("__quality") == 0).alias("bad"), *values)).alias("x"))
    rows = table.where("not x.base_failed").orderBy(F.xxhash64("doc_id"), "doc_id").select("x.*").collect()
    return learn_rules([(r["bad"], r.asDict()) for r in rows], list(features))


def verdict(rules: list[Rule], features: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(kept, the number of the first rule that rejects or null) as ordered conditional expressions over the statistics."""
    features = features or FEATURES
    number = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules, 1):
        number = number.when(rule.column(features), F.lit(i))
    return ~F.col("base_failed") & number.isNull(), number


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with STATS, base_failed, rule (number of the first that rejects) and kept; every row is judged on its own."""
    kept, number = verdict(rules)
    return with_statistics(docs.drop("rule", "kept")).withColumn("rule", number).withColumn("kept", kept)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", *STATS, "base_failed", "kept")
