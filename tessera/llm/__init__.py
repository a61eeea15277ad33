"""Training-data operators: decontamination, search, deduplication, privacy, extraction, filtering, formatting, mixing."""
