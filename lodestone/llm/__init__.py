"""Training-data operators: dedup, fingerprints, packing, mixing, token counts, language, toxicity, chat."""
