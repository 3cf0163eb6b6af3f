"""functions of the sequence engine."""
