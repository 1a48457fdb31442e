"""annoscope — Spark-native annotation corpora, text scoring and scorer evaluation.

DataFrame in, DataFrame out. Sub-packages:

* ``sources``   — readers and writers (CSV/TSV/JSON/lexicon/word-vector files, sinks)
* ``functions`` — Column-expression builders (text normalisation, hashing, ids, vectors, stats)
* ``operators`` — DataFrame -> DataFrame operators (tokens, lexicon scoring, curves, stats, ...)
* ``plans``     — derived fixtures and the registered query catalog with DuckDB oracles
* ``streaming`` — row-wise scoring on streaming DataFrames and the stream-stream interval join
"""

from annoscope.schema import CATEGORIES, DIMENSIONS

__all__ = ["CATEGORIES", "DIMENSIONS"]
