"""The corpus pipeline: quality rules, line dedup, near-dedup by fingerprints and shingle sets, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents; n_chars follows the text where a stage edits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, packing, quality, simhash, substring_dedup
from lodestone.llm._common import stored


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns under ``__row``: an operator's own columns can't touch them there."""
    other = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*other, F.lit(None).cast("int").alias("__")).alias("__row"))


def _as_documents(edited: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the text of ``edited`` and the n_chars that follows from it."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return edited.select(*[own[c] if c in own else F.col("__row").getField(c).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base checks or the learned rules reject go."""
    rules = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.judge(_apart(docs), rules).where("kept")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__row").getField(c).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs, and of single lines of five words or more, go from the texts; every document stays, if need be with an empty text."""
    return _as_documents(line_dedup.dedup_lines(_apart(docs), min_words=line_dedup.MIN_WORDS), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 0.8 or more of their five-word shingles the smallest doc_id stays: fingerprints
    find the nearest, and full sets decide. Rows without a doc_id stay, and so do texts without words, which are nobody's copies."""
    found = simhash.near_duplicates(docs, similarity=0.8)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    first = docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    return first.unionByName(docs.where("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds go from the texts."""
    return _as_documents(substring_dedup.dedup_substrings(_apart(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences; one without any text left is its end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("substring_dedup", substrings),
    ("packing", pack),
]

#: Learned rules, XXH64 fingerprints and a tokenizer aren't SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
