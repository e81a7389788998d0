"""Training-data operators: quality, dedup, mixing, packing, extraction, media and secrets."""
