"""Entity names: canonical form, exact match and token overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STRIP_PREFIXES = ["aws_", "azurerm_", "azure_", "google_", "gcp_", "gke_", "k8s_", "tf_", "var_", "data_"]
NOISE_TOKENS = ["deployment", "service", "configmap", "secret", "pod", "replicaset", "statefulset"]


def normalize_name(name: Column) -> Column:
    """Lower case, without stacked provider prefixes, separators as one ``_``, none at the ends."""
    bare = F.regexp_replace(F.lower(name), f"^({'|'.join(STRIP_PREFIXES)})+", "")
    return F.regexp_replace(F.regexp_replace(bare, "[-./: ]+", "_"), "^_+|_+$", "")


def name_tokens(normal: Column) -> Column:
    """Distinct tokens of a canonical name that are longer than one character and no kind suffix."""
    return F.array_distinct(F.filter(F.split(normal, "_"), lambda t: (F.length(t) > 1) & ~t.isin(*NOISE_TOKENS)))


def exact_name_match(a: Column, b: Column) -> Column:
    """1.0 for equal canonical forms that aren't empty, else 0.0."""
    left, right = normalize_name(a), normalize_name(b)
    return F.when((left == right) & (left != ""), F.lit(1.0)).otherwise(F.lit(0.0))


def dice(tokens_a: Column, tokens_b: Column) -> Column:
    total = F.size(tokens_a) + F.size(tokens_b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(tokens_a, tokens_b)) / total)


def resource_name_match(a: Column, b: Column) -> Column:
    """1.0 for equal canonical forms, else the Sorensen-Dice coefficient of their tokens."""
    left, right = normalize_name(a), normalize_name(b)
    score = F.when((left == right) & (left != ""), F.lit(1.0)).otherwise(dice(name_tokens(left), name_tokens(right)))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.lit(0.0)).otherwise(score)
