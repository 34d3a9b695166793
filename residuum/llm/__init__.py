"""Operators of a large-scale training-data pipeline (see ``queries.py`` for the registered forms)."""
