"""Operators that prepare text, chat and embedding tables for training.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
