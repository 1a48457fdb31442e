"""Streaming: row-wise scorers that work on streaming and batch DataFrames alike, and the
stream-stream interval join of posts and comments with watermarks."""
