"""Operators for training-data pipelines (deduplication, mixing, language,
toxicity, packing, decontamination, token counts, page text, near copies)."""
