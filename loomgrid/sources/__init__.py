"""Readers, and the dense grid that all time-series operators start from."""
