"""Column expressions (inventory H)."""
