"""Sequence-corpus analytics on Spark: k-mers, vocabularies, examples, embeddings and their evaluation."""
