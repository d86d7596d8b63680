"""Operators on texts and on large record sets for training-data pipelines. Nothing outside this package imports it."""
