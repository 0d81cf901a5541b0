"""Fusing and reordering ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine, literal

RRF_K = 60


def ranked(hits: DataFrame) -> DataFrame:
    """(chunk_id, rank from 1) by score. A list is a top-N result, so one small window numbers it."""
    return hits.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("rank"))


def reciprocal_rank_fusion(lists: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """(chunk_id, score = sum of 1 / (k + rank)); scores of the lists count for their order alone."""
    every = reduce(DataFrame.unionByName, [ranked(x) for x in lists])
    return every.groupBy("chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def noop_rerank(hits: DataFrame) -> DataFrame:
    """Scores 1, 1/2, 1/3 ... in the given order."""
    return ranked(hits).select("chunk_id", (F.lit(1.0) / F.col("rank")).alias("score"))


def rerank(hits: DataFrame, embed: Callable[[Column], Column], query: Sequence[float], top_k: int, *, candidates: int = 50, text: str = "text") -> DataFrame:
    """The first ``candidates`` hits, scored anew by their texts' cosine with the query, best ``top_k`` first."""
    pool = hits.orderBy(F.desc("score"), "chunk_id").limit(candidates)
    scored = pool.withColumn("score", cosine(embed(F.col(text)), literal(query)))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(top_k)
