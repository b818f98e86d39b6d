"""Near-deduplication and record linkage on Spark: rules over rows, canonical ids, golden records."""

from kindred import datasets
from kindred.api import CANONICAL_ID, Dedupe, dedupe, drop_duplicates_by
from kindred.dsl import Col, Pipeline, col, pipeline
from kindred.functions import preprocess as preprocessors
from kindred.operators import rules as custom
from kindred.operators.rules import (
    InvalidRuleError, Rule, cosine, exact, fuzzy, isin, isna, jaccard, lsh, register, register_key, register_pair_predicate,
    str_contains, str_endswith, str_len, str_startswith, tfidf,
)
from kindred.sources.batches import append_batch

__all__ = [
    "CANONICAL_ID", "Col", "Dedupe", "InvalidRuleError", "Pipeline", "Rule", "append_batch", "col", "cosine", "custom", "datasets", "dedupe",
    "drop_duplicates_by", "exact", "fuzzy", "isin", "isna", "jaccard", "lsh", "pipeline", "preprocessors", "register", "register_key",
    "register_pair_predicate", "str_contains", "str_endswith", "str_len", "str_startswith", "tfidf",
]
