"""Training-data operators: whole-corpus dedup, language, quality, packing, secrets."""
