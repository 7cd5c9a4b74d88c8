"""spanloom functions."""
