"""Operators for training-data pipelines over document tables."""
