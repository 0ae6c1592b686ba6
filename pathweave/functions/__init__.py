"""Column functions of AS paths, prefixes and archive names."""
