"""Training-data operators: packing, deduplication, scans, language ID, tokens, HTML."""
