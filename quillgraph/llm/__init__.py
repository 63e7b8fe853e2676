"""Training-data operators: filtering, deduplication, privacy, archives, token output."""
