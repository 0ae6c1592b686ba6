"""Training-data operators: language, packing, near and exact duplicates, secrets, personal data, mixing."""
