"""Task messages as tables, in batch and as streams: parsing, retries, dead letters."""
