"""Training-data operators: sharding, decontamination, licence scans, deduplication, scoring, packing, media, URLs, archives."""
