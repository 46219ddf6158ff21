"""functions of the quillet engine."""
