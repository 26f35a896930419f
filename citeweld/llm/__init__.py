"""Operators for building training corpora: deduplication, quality, sharding, search, packing, archives, mixing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
