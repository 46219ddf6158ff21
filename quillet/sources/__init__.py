"""sources of the quillet engine."""
