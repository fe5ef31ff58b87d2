"""Training-data operators: language ID, dedup, decontamination, extraction, scoring, sharding, packing."""
