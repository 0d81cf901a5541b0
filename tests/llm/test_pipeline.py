"""The pipeline against its stages in plain Python, on the smallest tables."""

import public_tokenizers
import pyarrow.parquet as pq
from test_dedup import WORDS, cut_words
from test_lines import cut
from test_minhash import linked
from test_models import check_pieces, stats_of
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import quality


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]

    def keeps(text):
        n, chars, symbols, dup, repeat = stats_of(text)
        if n < 50 or 100 * repeat > 50 * n:
            return False
        row = {"n_words": n, "mean_word": chars / n, "symbol_share": symbols / n, "dup_lines": dup, "repeat_share": repeat / n}
        return not any(r.holds(row) for r in rules)

    rows = [r for r in rows if keeps(r[1])]
    stage = docs
    names = []

    def step(i):
        nonlocal stage
        name, f = corpus_pipeline.STAGES[i]
        names.append(name)
        stage = spark.createDataFrame(f(spark, stage, sf).collect(), f(spark, stage, sf).schema)
        return sorted((r.doc_id, r.text) for r in stage.collect()) if i < 4 else stage.collect()

    assert step(0) == sorted(rows)
    assert stage.columns == docs.columns
    rows = [(d, t) for d, t, _ in cut(rows, 2, 5)]
    assert step(1) == sorted(rows)
    rows = [r for r, c in zip(rows, linked(rows)) if c == r[0]]
    assert step(2) == sorted(rows)
    got = step(3)
    assert [(d, WORDS.findall(t)) for d, t in got] == sorted(cut_words(rows, 50))
    assert stage.columns == docs.columns and all(r.n_chars == len(r.text) for r in stage.collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in got}
    check_pieces(step(4), ids, 4096)
    check_pieces(corpus_pipeline.run(spark, sf).collect(), ids, 4096)
