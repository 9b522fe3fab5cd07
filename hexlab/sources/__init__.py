"""Reading, listing, caching and writing."""
