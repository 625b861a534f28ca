"""Training-data operators: deduplication, mixing, scoring, search and media.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
