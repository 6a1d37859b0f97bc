"""Keyed state, in batch and as streams."""
