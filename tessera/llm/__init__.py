"""Training-data operators: scoring, tokenising, de-duplication, sharding, search, filtering, mixing and extraction."""
