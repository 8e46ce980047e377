"""Column builders and the numpy helpers that run inside tasks."""
