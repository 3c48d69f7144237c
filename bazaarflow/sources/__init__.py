"""Reading, loading and writing the marketplace tables."""
