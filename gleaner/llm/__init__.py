"""Operators of a training-data pipeline (dedup, packing, scoring, rules, PII, ...).

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
