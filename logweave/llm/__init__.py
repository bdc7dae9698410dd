"""Training-data operators: scoring, filtering, near-duplicates, packing, sharding, search.

Nothing outside this package, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
