"""Training-data operators: deduplication, filtering, mixing and feature extraction over document tables."""
