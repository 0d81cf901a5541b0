"""Line dedup: a suffix array of the corpus's line sequences by prefix doubling, and the repeated runs in it.

Lines become ids (128-bit hashes) in an arbitrary but total order. Prefix doubling then sorts the runs of 1, 2, 4, 8 ... lines
that start at each line: a run twice as long is the pair of the ranks of its halves, and its rank is the place of that pair
among all pairs, from a sort by range. Only places whose run occurs again go on, so unique text leaves at once, and doubling
ends when no run repeats. Places of one rank are an interval of the suffix array whose longest common prefix has at least
that many lines; of each interval the first place in the corpus stays, the others are later copies. What intervals of all
lengths cover is put together into maximal runs, which go. With ``min_words`` a repeat may also be a single line of so many
words, an interval of the first level.

Only DataFrame operations; intervals are reduced to their first place before they are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import SPACE, WORD, free, stored

MIN_LINES = 2
#: A single line of so many words is a repeat too in the registered query and the pipeline; shorter ones recur by chance.
MIN_WORDS = 5
_LINE = r"[^\x20\x09-\x0D]"
_PLACE = ["doc", "mark", "pos"]


def _ranked(level: DataFrame, names: list[str], kept: list[str]) -> DataFrame:
    """Places of ``level`` whose name occurs again, with the name's rank and whether the place is a later copy.

    Numbers of partitions sorted by range follow the order of the names. They are stored before they are joined back: both
    sides are then plain shuffles, which AQE splits where a name is hot, and a lost executor cannot number them anew.
    """
    again = level.groupBy(*names).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*_PLACE)).alias("first")).where("c > 1").drop("c")
    ranks = stored(again.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("order", F.monotonically_increasing_id()), "ranks")
    out = stored(level.join(ranks, names).select(*_PLACE, *kept, F.col("order").alias("rank"), (F.struct(*_PLACE) != F.col("first")).alias("later")), "level")
    free(level, ranks)
    return out


def _doubled(level: DataFrame, distance: int) -> DataFrame:
    """Places with the ranks of their own run and of the run that starts ``distance`` lines later."""
    after = level.select("doc", "mark", (F.col("pos") - distance).alias("pos"), F.col("rank").alias("rank2"))
    return stored(level.select(*_PLACE, "rank").join(after, _PLACE), "doubled")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """(doc, mark, start, end) of maximal runs of counted lines that are later copies; mark is the text's hash.

    Runs of a text share no line (with ``min_lines`` of 1 they don't touch either). With ``min_words`` single later copies of that many words count as runs too.
    """
    if min_lines < 1 or min_words is not None and min_words < 1:
        raise ValueError("min_lines and min_words must be at least 1")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), F.filter(F.split("text", "\n"), lambda x: x.rlike(_LINE)).alias("lines"))
    lines = texts.select("doc", "mark", F.posexplode("lines").alias("pos", "line"))
    long = F.col("line").rlike(rf"(?:{WORD}{SPACE}){{{min_words - 1}}}{_LINE}") if min_words is not None else F.lit(False)
    ids = stored(lines.select(*_PLACE, F.xxhash64("line").alias("x"), F.xxhash64(F.lit(1), "line").alias("y"), long.alias("long")).distinct(), "ids")
    level = _ranked(ids, ["x", "y"], ["long"])
    copies = [level.where("later and long").select(*_PLACE, F.lit(1).alias("n"))]
    length = 1
    while True:
        if length >= min_lines:
            copies.append(level.where("later").select(*_PLACE, F.lit(length).alias("n")))
        if level.isEmpty():
            break
        step = min(length, min_lines - length) if length < min_lines else length
        level = _ranked(_doubled(level, step), ["rank", "rank2"], [])
        length += step
    spans = copies[0]
    for c in copies[1:]:
        spans = spans.unionByName(c)
    # The longest interval at each place; runs that share a line are one.
    spans = spans.groupBy(*_PLACE).agg((F.col("pos") + F.max("n")).alias("end"))
    before = Window.partitionBy("doc", "mark").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(before)
    fresh = spans.withColumn("new", F.when(F.col("pos") <= reach if min_lines == 1 else F.col("pos") < reach, 0).otherwise(1))
    up_to = Window.partitionBy("doc", "mark").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return fresh.withColumn("run", F.sum("new").over(up_to)).groupBy("doc", "mark", "run").agg(F.min("pos").alias("start"), F.max("end").alias("end")).select("doc", "mark", "start", "end")


def dedup_lines(docs: DataFrame, *, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) without later copies of repeated line runs, with n_lines and n_deleted.

    Lines part at ``\\n``; those without a word aren't counted. A counted line goes if ``min_lines`` consecutive counted lines
    that hold it also stand earlier: in a document with a smaller doc_id, or above in the same one; with ``min_words`` also if
    the line alone stands earlier and has so many words. Copies are judged on the input. Lines without words inside a deleted
    run go with it. A text that loses all lines is empty. Null text stays null with no lines; rows with a null doc_id stay
    whole and delete nothing. Rows with one doc_id are ordered by their text's hash, identical rows are one. Columns named
    n_lines or n_deleted are replaced; an empty table stays empty. What stays of a text is joined from the stretches between
    its runs, in time linear in its lines.
    """
    docs = docs.drop("n_lines", "n_deleted")
    names = [F.col("row").getField(c).alias(c) for c in docs.columns]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    runs = repeated_runs(docs, min_lines, min_words).groupBy("doc", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    runs = runs.select(F.col("doc").alias("d"), F.col("mark").alias("m"), "runs")
    joined = keyed.join(runs.hint("shuffle_hash"), (F.col("doc") == F.col("d")) & (F.col("mark") == F.col("m")), "left")
    # Nested lambdas bind the lines, the places of counted lines and the stretches once; a generator keeps them apart.
    edited = F.expr(
        r"""inline(transform(array(split(row.text, '\n')), lines -> transform(array(filter(sequence(0, size(lines) - 1), i -> lines[i] rlike '[^\\x20\\x09-\\x0D]')), counted ->
        named_struct(
          '__n', cast(size(counted) as bigint),
          '__text', case when runs is null then row.text else array_join(transform(filter(transform(sequence(0, size(runs)), i -> named_struct(
              'a', if(i = 0, 0, counted[runs[i - 1].end - 1] + 1), 'b', if(i = size(runs), size(lines), counted[get(runs, i).start]))),
            s -> s.a < s.b), s -> array_join(slice(lines, s.a + 1, s.b - s.a), '\n')), '\n') end,
          '__gone', case when runs is null then 0L else aggregate(runs, 0L, (n, r) -> n + r.end - r.start) end
        ))[0]))"""
    )
    whole = joined.withColumn("__has", F.col("row.text").isNotNull()).where("__has").select("row", edited)
    text = [F.col("__text").alias(c) if c == "text" else n for c, n in zip(docs.columns, names)]
    done = whole.select(*text, F.col("__n").alias("n_lines"), F.col("__gone").alias("n_deleted"))
    return done.unionByName(docs.where("text is null").withColumns({"n_lines": F.lit(0).cast("long"), "n_deleted": F.lit(0).cast("long")}))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, min_words=MIN_WORDS).select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op8_line_dedup": rf"""
with raw as (select doc_id, r, line, regexp_matches(line, '[^\x20\x09-\x0D]') as counted
  from (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as r from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null))),
c as (select doc_id, r, line, row_number() over (partition by doc_id order by r) as pos from raw where counted),
w as (select doc_id, pos, line, lead(line) over (partition by doc_id order by pos) as next from c),
f as (select line, next, min((doc_id, pos)) as first from w where next is not null group by all),
later as (select doc_id, pos from w join f using (line, next) where (doc_id, pos) <> first),
g as (select line, min((doc_id, pos)) as first from c where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS} group by line),
alone as (select doc_id, pos from c join g using (line) where (doc_id, pos) <> first),
cut as (select doc_id, pos + k as pos from later, (values (0), (1)) t(k) union select doc_id, pos from alone),
numbered as (select raw.*, count(*) filter (where counted) over (partition by doc_id order by r) as p from raw),
marked as (select n.*, case when counted then cut.pos is not null else later.pos is not null end as gone
  from numbered n left join cut on n.doc_id = cut.doc_id and n.p = cut.pos and counted left join later on n.doc_id = later.doc_id and n.p = later.pos and not counted)
select doc_id, count(*) filter (where counted) as n_lines, count(*) filter (where counted and gone) as n_deleted,
  sha256(coalesce(string_agg(line, chr(10) order by r) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
union all select doc_id, 0, 0, null from documents where text is null
"""
}
