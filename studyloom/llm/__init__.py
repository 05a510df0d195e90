"""Training-data operators: deduplication, decontamination, counting, audit, filtering, mixing, formatting."""
