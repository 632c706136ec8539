"""Operators for large-scale training-data pipelines, with their registered queries."""
