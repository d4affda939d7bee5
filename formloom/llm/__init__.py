"""Training-data operators: tokenising, deduplication, mixing, scoring, search."""
