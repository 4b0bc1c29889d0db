"""Training-data pipeline operators: scoring, filtering, deduplication and mixing of documents."""
