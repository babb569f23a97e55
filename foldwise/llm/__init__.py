"""Operators for preparing text to train language models on.

Nothing outside this package imports it, except ``corpus_pipeline.py``.
"""
