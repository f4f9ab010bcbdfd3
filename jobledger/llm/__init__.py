"""Operators for preparing training text: deduplication, filters, mixing, sharding and language models of small size.

Nothing outside this folder (besides the registration in ``__spark_entry__.py`` and ``corpus_pipeline.py``) uses it.
"""
