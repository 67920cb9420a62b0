"""Training-data operators: sharding, deduplication, packing, decontamination, archives, scans, scoring."""
