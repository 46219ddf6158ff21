"""streaming of the quillet engine."""
