"""Files of any store that Spark reads."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.registry import content_type

MAX_BYTES = 1_000_000


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: ``**`` crosses folders, ``*`` and ``?`` don't."""
    if pattern in ("**/*", "**", "*"):
        return ".*"
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])), i + 1
    return f"(?:.*/)?{out}" if "/" not in pattern or not pattern.startswith("/") else out


def matches(path: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(f"^{glob_regex(p)}$")
    return out


class FileConnector:
    """``root``: a folder. Hidden files and folders are left out, then ``include`` and ``exclude`` patterns apply."""

    def __init__(self, root: str, include: Sequence[str] = ("**/*",), exclude: Sequence[str] = (), max_file_size_bytes: int = MAX_BYTES):
        self.root, self.include, self.exclude, self.most = root.rstrip("/"), include, exclude, max_file_size_bytes

    def validate(self, spark: SparkSession) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(self.root)

    def _files(self, spark: SparkSession, content: bool) -> DataFrame:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        bare = self.root.split(":", 1)[-1].lstrip("/") if ":" in self.root else self.root.lstrip("/")
        path = F.element_at(F.split("path", re.escape(bare) + "/", 2), -1)
        kind = content_type(F.col("external_id"))
        out = raw.select(path.alias("external_id"), F.col("path").alias("uri"), F.col("modificationTime").alias("updated_at"), F.col("length").alias("size"), *(["content"] if content else []))
        hidden = F.col("external_id").rlike(r"(^|/)\.")
        kept = out.where(~hidden & (F.col("size") <= self.most) & ~F.col("external_id").contains("..") & matches(F.col("external_id"), self.include) & ~matches(F.col("external_id"), self.exclude))
        return kept.withColumn("content_type", kind)

    def discover(self, spark: SparkSession) -> DataFrame:
        f = self._files(spark, False)
        return f.select("external_id", "uri", "updated_at", F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("content_type"), F.col("content_type")).alias("metadata"))

    def fetch(self, spark: SparkSession, refs: DataFrame | None = None) -> DataFrame:
        f = self._files(spark, True)
        f = f if refs is None else f.join(refs.select("external_id"), "external_id", "left_semi")
        return f.select("external_id", "uri", "updated_at", "content_type", "content")
