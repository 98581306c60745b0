"""Influence and event analytics as plain Spark DataFrame transforms."""
