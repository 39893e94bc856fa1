"""Training-data operators: deduplication, scans, mixing, encoding, chat formatting and media columns."""
