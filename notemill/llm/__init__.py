"""Training-data operators: deduplication, search, scoring, packing, extraction and encoding.

Nothing outside this package (and `corpus_pipeline.py`) imports it.
"""
