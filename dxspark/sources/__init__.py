"""Readers and writers (inventory A)."""
