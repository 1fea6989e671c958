"""Operators for preparing training data: toxicity, token counts, nearest neighbours,
sharding, token files, decontamination, language ID, PII, BPE and near-duplicates."""
