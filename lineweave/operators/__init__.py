"""operators of the sequence engine."""
