"""Training-data operators: extraction, search, scans, deduplication, mixing and formatting on Spark."""
