"""Normalising, hashing, counting and chunking of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line ends and white space that count, spelled out: Java's classes know ASCII only. Fixed values.
LINE_END = r"(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])"
BLANKS = r"[\t \x1F\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
WHITE = r"[\t-\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def normalize_content(text: Column) -> Column:
    """Without byte order marks, trailing blanks and runs of blank lines; every line end becomes ``\\n``."""
    out = F.regexp_replace(text, r"^\x{FEFF}+", "")
    out = F.regexp_replace(out, LINE_END, "\n")
    out = F.regexp_replace(out, BLANKS + r"+(?=\n|\z)", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"\A\n+", "\n")
    return F.regexp_replace(out, r"\n+\z", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the normalised text, in hex."""
    return F.sha2(normalize_content(text), 256)


def fingerprint(*parts: Column) -> Column:
    """SHA-1 of the parts joined by colons: the external id of a versioned item."""
    return F.sha1(F.concat_ws(":", *[p.cast("string") for p in parts]))


def decode_utf8(content: Column) -> Column:
    """Bytes as text; malformed ones become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE + "+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(split_words(text))


def windows(words: Column, max_words: int, overlap: int) -> Column:
    """Texts of windows of at most ``max_words`` words, each ``overlap`` words into the one before; none for no words."""
    step = max(1, max_words - overlap)
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - F.lit(max_words) + F.lit(step - 1), F.lit(0)), F.lit(step))
    every = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, max_words), " "))
    return F.when(n > 0, every).otherwise(F.array().cast("array<string>"))


def heading_prefix(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n\n"))).otherwise(F.lit(""))


def fixed_windows(docs: DataFrame, *, text: str = "text", max_words: int = 512, overlap: int = 128) -> DataFrame:
    """A row per window of a document's text: all its columns, ``ord`` from 0 and ``chunk_text``."""
    listed = docs.withColumn("__w", split_words(F.coalesce(F.col(text), F.lit(""))))
    return listed.select(*docs.columns, F.posexplode(windows(F.col("__w"), max_words, overlap)).alias("ord", "chunk_text"))


def _per_section(docs: DataFrame, strategy: str, max_words: int, overlap: int, counted) -> DataFrame:
    """Chunks of ``sections`` in order; ``counted`` measures a section's prefix and text."""
    rows = docs.select(*[c for c in docs.columns if c != "sections"], F.posexplode("sections").alias("section_ord", "s"))
    rows = rows.where("trim(s.text) <> ''")
    prefix = heading_prefix(F.col("s.heading_path"))
    words = split_words(F.col("s.text"))
    small = counted(prefix, F.col("s.text")) <= max_words
    parts = F.when(small, F.array(F.concat(prefix, F.col("s.text")))).otherwise(F.transform(windows(words, max_words, overlap), lambda w: F.concat(prefix, w)))
    keep = [c for c in docs.columns if c != "sections"]
    every = rows.select(*keep, "section_ord", "s", F.size(parts).alias("__n"), F.posexplode(parts).alias("window", "chunk_text"))
    span = F.concat(F.lit("["), F.col("s.line_start"), F.lit(", "), F.col("s.line_end"), F.lit("]"))
    own = {"strategy": F.lit(strategy), "section_path": F.when(F.lit(strategy == "markdown_section"), F.array_join("s.heading_path", " > ")), "line_range": F.when(F.coalesce(F.col("s.line_start"), F.lit(0)) > 0, span), "window_index": F.when(F.col("__n") > 1, F.col("window").cast("string"))}
    pairs = F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    meta = F.map_concat(pairs, F.coalesce(F.col("s.metadata"), F.create_map().cast("map<string,string>")))
    ordinal = F.struct("section_ord", "window")
    return every.select(*keep, ordinal.alias("__o"), "chunk_text", F.col("s.symbol").alias("symbol"), meta.alias("metadata"), F.col("s.line_start").alias("line_start"), F.col("s.line_end").alias("line_end"), F.lit(strategy).alias("chunker_strategy"))


def code_symbol_chunks(docs: DataFrame, *, max_words: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks by symbol: a section is split by the words of its own text; every window gets the heading prefix."""
    return _per_section(docs, "code_symbol", max_words, overlap, lambda p, t: token_count(t))


def markdown_section_chunks(docs: DataFrame, *, max_words: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks by section: prefix and text are measured together, so a split window may be longer by its prefix."""
    return _per_section(docs, "markdown_section", max_words, overlap, lambda p, t: token_count(F.concat(p, t)))


def with_ordinal(chunks: DataFrame, key: str) -> DataFrame:
    """``ord`` from 0 within ``key`` over sections and windows. A key's chunks are those of one document."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy("__o")) - 1
    return chunks.withColumn("ord", rank).drop("__o")
