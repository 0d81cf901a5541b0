"""Full text: tokens, postings, boolean match and cover-density rank.

The index is a postings table (chunk_id, lexeme, positions). Written, it is partitioned by buckets of lexemes and sorted by
lexeme: a query reads the buckets and row groups of its lexemes only. Without an index a query scans the texts: chunks that
lack one of its words go before they are tokenised, and nothing is shuffled. Stop words are dropped but count as positions.
With ``stem`` tokens are reduced by the published English (Porter2) algorithm, over distinct tokens of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import ConfigError

TOKEN = r"[\p{L}\p{N}]+"
#: English stop words (fixed values).
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same so than too very s t can
will just don should now""".split()
#: Texts whose tokens are counted at once.
ROWS = 256

_VOWELS = "aeiouy"
#: Fixed values of the published English (Porter2) algorithm: endings with what replaces them by step, longest first; words
#: with stems of their own; words that step 1a completes; beginnings that R1 follows; letters before a removable ``li``.
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
_DONE = set("inning outing canning herring earring proceed exceed succeed".split())
_HEADS = ("gener", "commun", "arsen")
_BEFORE_LI = "cdeghkmnrt"


def _region(word: str, start: int) -> int:
    """Where the part begins that follows the first non-vowel after a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends with a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def english_stem(word: str) -> str:
    """The stem of a lower-case word by the Porter2 algorithm."""
    if len(word) < 3 or not word.isascii():
        return word
    if word in _OWN:
        return _OWN[word]
    w = word.removeprefix("'")
    # A y that is no vowel is written Y until the end.
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in "aeiouy" and not (w[i - 1] == "y" and i > 1 and w[i - 2] in "aeiou")) else c for i, c in enumerate(w))
    head = next((h for h in _HEADS if w.startswith(h)), None)
    r1 = len(head) if head else _region(w, 0)
    r2 = _region(w, r1)
    w = w.removesuffix("'").removesuffix("'s")
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _DONE:
        return w
    if cut := next((x for x in ("eedly", "eed") if w.endswith(x)), None):
        w = w[: -len(cut)] + "ee" if len(w) - len(cut) >= r1 else w
    elif (cut := next((x for x in ("ingly", "edly", "ing", "ed") if w.endswith(x)), None)) and any(c in _VOWELS for c in w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    if (found := next(((x, to) for x, to in _STEP2 if w.endswith(x)), None)) and len(w) - len(found[0]) >= r1:
        rest = w[: -len(found[0])]
        if (found[0] != "ogi" or rest.endswith("l")) and (found[0] != "li" or rest[-1:] and rest[-1] in _BEFORE_LI):
            w = rest + found[1]
    if (found := next(((x, to) for x, to in _STEP3 if w.endswith(x)), None)) and len(w) - len(found[0]) >= (r2 if found[0] == "ative" else r1):
        w = w[: -len(found[0])] + found[1]
    if (cut := next((x for x in _STEP4 if w.endswith(x)), None)) and len(w) - len(cut) >= r2 and (cut != "ion" or w[: -len(cut)].endswith(("s", "t"))):
        w = w[: -len(cut)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for batch in batches:
        out = []
        for tokens in batch:
            for t in tokens if tokens is not None else ():
                if t not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[t] = english_stem(t)
            out.append(None if tokens is None else [known.get(t) or english_stem(t) for t in tokens])
        yield pd.Series(out)


def tokens(text: Column, *, stem: bool = False) -> Column:
    """All tokens of a text in order, stop words included."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return stemmed_tokens(raw) if stem else raw


def stemmed_tokens(raw: Column) -> Column:
    return F.pandas_udf(_stems, "array<string>")(raw)


def dropped(stem: bool = False) -> list[str]:
    """The lexemes that no posting has."""
    return sorted({*STOP_WORDS, *map(english_stem, STOP_WORDS)} if stem else STOP_WORDS)


def _by_lexeme(stop: list[str]):
    """(chunk_id, tokens) to (chunk_id, lexeme, positions) of each lexeme of a row, without those of ``stop``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, listed = (batch.column(c).slice(at, ROWS) for c in ("chunk_id", "tokens"))
                sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(ids)), sizes)
                position = np.arange(1, len(row) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                words = listed.flatten().dictionary_encode()
                code, known = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
                kept = ~pc.is_in(known, pa.array(stop, known.type)).to_numpy(zero_copy_only=False)[code]
                row, position, code = row[kept], position[kept], code[kept]
                if not len(row):
                    continue
                key = row * len(known) + code
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                first = order[starts]
                positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(position[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[first])), known.take(pa.array(code[first])), positions], ["chunk_id", "lexeme", "positions"])

    return run


def postings(chunks: DataFrame, *, id: str = "chunk_id", text: str = "text", stem: bool = False) -> DataFrame:
    """(chunk_id, lexeme, positions from 1). A text's tokens are counted per lexeme in its task: nothing is shuffled, and ids are
    taken as distinct."""
    listed = chunks.select(F.col(id).alias("chunk_id"), tokens(F.col(text), stem=stem).alias("tokens"))
    return listed.mapInArrow(_by_lexeme(dropped(stem)), T.StructType([listed.schema["chunk_id"]]).add("lexeme", "string").add("positions", T.ArrayType(T.IntegerType())))


#: What a packed row holds of a chunk's postings.
_PACKED = pa.schema([("lexeme", pa.string()), ("positions", pa.list_(pa.int32()))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with those of a chunk that follow each other as one compressed row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("chunk_id")
        other = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True).to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(other) + 1)
        rows = pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in _PACKED], schema=_PACKED)
        raw = [rows.slice(a, b - a).serialize() for a, b in zip(starts, np.append(starts[1:], len(ids)))]
        held = pa.array([pa.compress(r, "zstd", asbytes=True) for r in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), pa.array([r.size for r in raw], pa.int32()), held], ["chunk_id", "size", "held"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of :func:`_packed` again."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            ids, sizes, held = (batch.column(c).slice(at, ROWS) for c in ("chunk_id", "size", "held"))
            parts = [pa.ipc.read_record_batch(pa.decompress(h.as_buffer(), n, "zstd"), _PACKED) for h, n in zip(held, sizes.to_pylist())]
            rows = pa.Table.from_batches(parts, _PACKED).combine_chunks().to_batches()[0]
            of = pa.array(np.repeat(np.arange(len(ids)), [p.num_rows for p in parts]))
            yield pa.RecordBatch.from_arrays([ids.take(of), *rows.columns], ["chunk_id", *_PACKED.names])


def without_chunks(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """``postings`` (chunk_id, lexeme, positions) without those of the chunks ``gone`` (chunk_id). A chunk's postings are
    shuffled as one compressed row, not one by one."""
    rows = postings.select("chunk_id", "lexeme", "positions")
    key = T.StructType([rows.schema["chunk_id"]])
    kept = rows.mapInArrow(_packed, T.StructType([*key]).add("size", T.IntegerType()).add("held", T.BinaryType())).join(gone, "chunk_id", "left_anti")
    return kept.mapInArrow(_unpacked, T.StructType([*key]).add("lexeme", "string").add("positions", T.ArrayType(T.IntegerType())))


def query_lexemes(query: str, *, stem: bool = False) -> list[str]:
    """Distinct lexemes of a query, without stop words, in order."""
    import regex

    found = [t for t in regex.findall(TOKEN, query.lower()) if t not in STOP_WORDS]
    return list(dict.fromkeys(english_stem(t) if stem else t for t in found))


BUCKETS = 64


def write_index(postings: DataFrame, path: str, *, buckets: int = BUCKETS, stem: bool = False) -> None:
    """Writes ``postings`` by bucket of lexemes; a frequent lexeme's rows are spread over several tasks and files. ``stem``
    says whether they have stems."""
    rows = postings.withColumn("bucket", F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int"))
    dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("chunk_id"), F.lit(4)))
    dealt.sortWithinPartitions("bucket", "lexeme").write.partitionBy("bucket").mode("overwrite").parquet(path)
    postings.sparkSession.createDataFrame([(buckets, stem)], "buckets int, stem boolean").coalesce(1).write.mode("overwrite").json(f"{path}/_about")


class Postings:
    """Postings in a table, with whether they have stems."""

    def __init__(self, rows: DataFrame, stem: bool = False):
        self.rows, self.stem = rows, stem

    def of(self, lexemes: list[str]) -> DataFrame:
        return self.rows.where(F.col("lexeme").isin(*lexemes) if lexemes else F.lit(False))


class WrittenIndex:
    """Postings that :func:`write_index` wrote."""

    def __init__(self, spark, path: str):
        self.buckets, self.stem = spark.read.schema("buckets int, stem boolean").json(f"{path}/_about").first()
        self.rows = spark.read.parquet(path)

    def of(self, lexemes: list[str]) -> DataFrame:
        """The postings of ``lexemes``, by partitions and row groups that can hold them."""
        from xxhash import xxh64_intdigest

        signed = [h - (1 << 64) if (h := xxh64_intdigest(x.encode(), 42)) >> 63 else h for x in lexemes]
        return self.rows.where(F.col("bucket").isin(*sorted({h % self.buckets for h in signed})) & F.col("lexeme").isin(*lexemes)).drop("bucket") if lexemes else self.rows.where(F.lit(False)).drop("bucket")


class Texts:
    """Chunks that are searched without an index."""

    def __init__(self, chunks: DataFrame, *, id: str = "chunk_id", text: str = "text"):
        self.chunks = chunks.select(F.col(id).alias("chunk_id"), F.col(text).alias("text"))

    def matching(self, lexemes: list[str], *, stem: bool = False) -> DataFrame:
        """(chunk_id, hits) as :func:`match` gives them."""
        rows = self.chunks
        for x in lexemes if not stem else ():
            rows = rows.where(F.contains(F.lower("text"), F.lit(x)))
        spread = F.transform(tokens(F.col("text"), stem=stem), lambda t, i: F.struct((i + 1).alias("p"), t.alias("l")))
        hits = F.filter(spread, lambda h: h["l"].isin(*lexemes)) if lexemes else F.slice(spread, 1, 0)
        # A generator between them: the condition on the hits would else tokenise once more.
        found = rows.select("chunk_id", F.explode(F.array(hits)).alias("hits"))
        return found.where((F.size(F.array_distinct("hits.l")) == len(lexemes)) & F.lit(bool(lexemes)))


class Ranked:
    """An index that finds the best matches of a query by itself."""

    stem: bool

    def top(self, query: str, limit: int) -> DataFrame:
        """(chunk_id, score) of the ``limit`` best matches, ties by chunk_id."""
        raise NotImplementedError


Index = DataFrame | Postings | WrittenIndex | Texts | Ranked


def match(index: Index, lexemes: list[str], *, stem: bool = False) -> DataFrame:
    """(chunk_id, hits) of chunks that hold all ``lexemes``; hits are (position, lexeme) in order. No lexemes match nothing."""
    if isinstance(index, Texts):
        return index.matching(lexemes, stem=stem)
    found = (Postings(index) if isinstance(index, DataFrame) else index).of(lexemes)
    spread = F.transform("positions", lambda p: F.struct(p.alias("p"), F.col("lexeme").alias("l")))
    per_chunk = found.groupBy("chunk_id").agg(F.count_distinct("lexeme").alias("n"), F.sort_array(F.flatten(F.collect_list(spread))).alias("hits"))
    return per_chunk.where(F.col("n") == len(lexemes)).drop("n")


def cover_density(hits: Column, n_lexemes: int | Column) -> Column:
    """Sum over minimal covers of 0.1 / (1 + words in between that are no hits).

    With one or two lexemes each cover is a hit, or two neighbours with different lexemes; with more, or a number that differs
    by row, hits are folded one by one over the last hit of each lexeme. All of it stays in the JVM.
    """
    if not isinstance(n_lexemes, Column):
        if n_lexemes == 1:
            return F.size(hits) * 0.1
        if n_lexemes == 2:
            pairs = F.transform(hits, lambda h, i: F.when(h["l"] != F.get(hits, i - 1)["l"], F.lit(0.1) / (h["p"] - F.get(hits, i - 1)["p"])).otherwise(F.lit(0.0)))
            return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
        n_lexemes = F.lit(n_lexemes)

    # A cover ends at a hit and starts at the earliest of the other lexemes' last hits since the cover before it started.
    def step(s: Column, h: Column) -> Column:
        seen = F.concat(F.filter(s["seen"], lambda x: x["l"] != h["l"]), F.array(F.struct(h["p"].alias("p"), h["l"].alias("l"), s["n"].alias("i"))))
        start = F.get(seen, F.lit(0))  # the lexeme whose last hit is farthest back
        full = F.size(seen) == n_lexemes
        between = F.greatest(F.lit(0), h["p"] - start["p"] - (s["n"] - start["i"]))
        return F.struct(
            (s["total"] + F.when(full, F.lit(0.1) / (1 + between)).otherwise(0.0)).alias("total"), (s["n"] + 1).alias("n"),
            F.when(full, F.slice(seen, F.lit(2), F.greatest(F.lit(1), n_lexemes - 1))).otherwise(seen).alias("seen"),
        )

    none = F.array().cast("array<struct<p:int,l:string,i:int>>")
    return F.aggregate(hits, F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), none.alias("seen")), step, lambda s: s["total"])


def stemmed(index: Index, stem: bool | None, default: bool = False) -> bool:
    """Whether queries of ``index`` are stemmed: as it was made, if it knows, else as asked for."""
    known = getattr(index, "stem", None) if isinstance(index, Postings | WrittenIndex | Ranked) else None
    if known is not None and stem is not None and known != stem:
        raise ConfigError("queries must be stemmed exactly if the index is", index=known, query=stem)
    return known if known is not None else default if stem is None else stem


def search(index: Index, query: str, limit: int, *, stem: bool | None = None) -> DataFrame:
    """(chunk_id, score): the ``limit`` best matches of all the query's lexemes, ties by chunk_id. An index that knows whether
    it has stems decides that, and refuses to be asked otherwise."""
    stem = stemmed(index, stem)
    if isinstance(index, Ranked):
        return index.top(query, limit)
    lexemes = query_lexemes(query, stem=stem)
    scored = match(index, lexemes, stem=stem).select("chunk_id", cover_density(F.col("hits"), max(1, len(lexemes))).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(limit)
