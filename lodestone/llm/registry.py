"""The queries of this subpackage and their SQL."""

from importlib import import_module

NAMES = ["url_filter", "warc", "substring_dedup", "quality", "simhash", "packing", "topk", "pieces", "line_dedup", "chat", "minhash", "divergence", "merkle"]


#: Imported with this module, so that one that can't be is known at once.
MODULES = [import_module(f"lodestone.llm.{m}") for m in NAMES]


#: Besides one query for each operator: op5's Viterbi, which its own query's model doesn't use.
MORE = {"sentencepiece_unigram": import_module("lodestone.llm.pieces").sentencepiece_unigram}


def queries() -> dict:
    return MORE | {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and callable(f) and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
