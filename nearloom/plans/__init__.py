"""Registered queries over the given tables, with their plain SQL twins."""
