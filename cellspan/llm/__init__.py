"""Training-data operators: deduplication, scoring, filtering, mixing and extraction over document tables."""
