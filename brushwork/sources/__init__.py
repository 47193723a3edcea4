"""Reading, naming, caching and writing tables."""
