"""Training-data operators: search, filtering, deduplication, extraction, mixing, language."""
