"""operators of the quillet engine."""
