"""Training-data operators: scans, dedup, scoring, counting and mixing of documents."""
