"""Operators for large-scale training data: classification, mixing, deduplication, decontamination, scans, output.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
