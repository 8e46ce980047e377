"""Vector files, data sets, result tables and the persisted index."""
