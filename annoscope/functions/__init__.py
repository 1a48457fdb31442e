"""Column-expression builders. Every function returns a ``pyspark.sql.Column`` that stays
inside whole-stage codegen (no Python per row) unless its docstring says otherwise."""

from annoscope.functions.hashing import u01, stable_rank_key
from annoscope.functions.text import (
    WHITESPACE_CLASS,
    TOKEN_PATTERN,
    SENTENCE_PATTERN,
    normalize_text,
    tokens,
)
from annoscope.functions.ids import (
    TWITTER_EPOCH_MS,
    snowflake_encode,
    snowflake_decode,
    snowflake_date,
    url_date,
)
from annoscope.functions.vec import cosine, dot, l2_norm, l2_normalize
from annoscope.functions.predicates import (
    interval_overlap,
    binarize,
    significance_stars,
    tristate_label,
    twostate_label,
    none_label,
    top_n_mask,
)

__all__ = [
    "u01", "stable_rank_key", "WHITESPACE_CLASS", "TOKEN_PATTERN", "SENTENCE_PATTERN",
    "normalize_text", "tokens", "TWITTER_EPOCH_MS", "snowflake_encode", "snowflake_decode",
    "snowflake_date", "url_date", "cosine", "dot", "l2_norm", "l2_normalize",
    "interval_overlap", "binarize", "significance_stars", "tristate_label", "twostate_label",
    "none_label", "top_n_mask",
]
