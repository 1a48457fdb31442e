"""Registered queries, one module per group. Importing registers them."""

from annoscope.plans.catalog import (  # noqa: F401
    text,
    lexicon,
    evaluation,
    thresholds,
    social,
    stats,
    annotation,
    splits,
    profile,
    vectors,
    fitted,
    io,
    streaming,
)
