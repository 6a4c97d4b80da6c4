"""Training-data operators: mixing, search, scoring, cleaning, packing, archives and near-duplicates."""
