"""Training-data operators: decontamination, deduplication, extraction, mixing, sharding.

Nothing outside this subpackage imports it.
"""
