"""Operators for preparing training text at corpus scale.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
