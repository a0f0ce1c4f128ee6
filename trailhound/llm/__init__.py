"""Operators for building training data: scoring, fingerprints, near-duplicates, tokens, packing, toxicity, language, shards.

Nothing else in the package imports this one. Every operator takes DataFrames and returns DataFrames; what must be read
more than once is written to the shared folder (``spark.checkpoint.dir``) and read back, so that a lost executor costs a
re-read and not a re-run.
"""
