"""Training-data operators: deduplication, archives, quality, mixing and sharding on Spark."""
