"""Operators for preparing training text; ``catalog`` registers their queries.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
