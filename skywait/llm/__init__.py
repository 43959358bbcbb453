"""Training-data operators: sharding, deduplication, mixing, scoring, packing and filters."""
