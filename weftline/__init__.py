"""Corpus analytics on Spark: nodes of hierarchical text, their search, trees, changes, quality and evaluation."""
