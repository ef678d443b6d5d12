"""Training-data operators: tokens, PII, deduplication, search, decontamination, sharding, licences, quality, runs, hard negatives.

Nothing outside this subpackage imports it.
"""
