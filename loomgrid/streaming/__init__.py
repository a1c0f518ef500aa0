"""Replay of readings as a stream."""
