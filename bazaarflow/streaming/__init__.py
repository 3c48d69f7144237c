"""The folds as Structured Streaming queries."""
