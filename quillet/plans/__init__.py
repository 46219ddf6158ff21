"""plans of the quillet engine."""
