"""Ordered-event analytics expressed as DataFrame pipelines."""
