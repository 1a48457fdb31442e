"""Training-data operators: cleaning, near-duplicate search, scoring and mixing of large corpora.

Nothing else in the library imports this subpackage; ``queries.py`` holds its registered queries.
"""
