"""Training-data operators: deduplication, filtering, token output, packing and vector search on Spark."""
