"""Training-data operators: dedup, extraction, scoring, search, scans, packing and formatting."""
