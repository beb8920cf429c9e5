"""Training-data operators (toxicity, near-dedup, decontamination, secrets, packing, ...)."""
