"""Operators for large-scale training-data pipelines.  Nothing else in ``intervale`` imports this package."""
