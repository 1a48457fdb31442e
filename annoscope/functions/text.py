"""Text expressions: normalisation (B1) and tokenisation patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's ``str.isspace`` treats as white space, spelled out so that
# Java regex, RE2 (DuckDB) and Python agree (plain ``\s`` is ASCII-only in Java and RE2).
WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Token = a run of letters/digits, or one other non-space character (punctuation is a token).
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"

# Sentence = text up to and including a run of terminators and the white space after it.
SENTENCE_PATTERN = r"[^.!?]+[.!?]*\s*"

# The normalisation rules, applied in this order (pattern, replacement).
NORMALIZE_RULES: tuple[tuple[str, str], ...] = (
    ('"', "'"),
    (WHITESPACE_CLASS + "+", " "),
    (r" \. \. \.", " ..."),
    ("…", "..."),
    ("“", "'"),
    ("”", "'"),
    ("‘", "'"),
    ("’", "'"),
    ("­", ""),
)


# The single-character quote rules commute with the white-space and ellipsis rules (no rule
# creates or consumes a quote), so they run first as one ``translate`` pass; the soft hyphen is
# deleted last, after white-space runs were collapsed, exactly as in the rule order above.
_QUOTES_FROM = "\"\u201c\u201d\u2018\u2019"
_QUOTES_TO = "'" * 5


def normalize_text(col) -> Column:
    """B1: quote, white-space, ellipsis and soft-hyphen normalisation (same result as applying
    ``NORMALIZE_RULES`` in order; one regex pass, the rest literal)."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.translate(c, _QUOTES_FROM, _QUOTES_TO)
    c = F.regexp_replace(c, F.lit(WHITESPACE_CLASS + "+"), F.lit(" "))
    c = F.replace(c, F.lit(" . . ."), F.lit(" ..."))
    c = F.replace(c, F.lit("\u2026"), F.lit("..."))
    return F.translate(c, "\u00ad", "")


def tokens(col, lower: bool = True, pattern: str = TOKEN_PATTERN) -> Column:
    """Array of tokens of a text column (lower-cased by default)."""
    c = F.col(col) if isinstance(col, str) else col
    if lower:
        c = F.lower(c)
    return F.regexp_extract_all(c, F.lit(pattern), 0)
