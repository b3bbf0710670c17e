"""Lodeworks: building, auditing, matching and tracking a table of organisations on Spark."""
