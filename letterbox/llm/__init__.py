"""Training-data operators: dedup, mixing, packing, archives, quality, language, secrets, token files."""
