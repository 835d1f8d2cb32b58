"""Operators for training-data pipelines over ``documents``, ``embeddings``, ``pages`` and
``conversations``. Nothing outside this folder and ``corpus_pipeline.py`` imports it."""
