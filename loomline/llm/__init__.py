"""Training-data pipeline operators: sharding, BPE, secret scans, vector search,
near-dedup, fingerprints, language ID, token-ID files, toxicity and source mixing.

Nothing else in the library imports this subpackage.
"""
