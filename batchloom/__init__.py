"""Preparation, tracking and retrieval of large batches of language-model requests, as Spark plans."""
