"""Fixture views, the query registry, and the registered queries per inventory group."""
