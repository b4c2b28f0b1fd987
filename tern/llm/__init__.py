"""Corpus operators for training-data pipelines (see ``queries.py``)."""
