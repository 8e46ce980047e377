"""Structured Streaming: encoding, online search and incremental index growth."""
