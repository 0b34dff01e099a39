"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; ``queries.py`` registers its
queries and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
