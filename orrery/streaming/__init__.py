"""Structured Streaming operators; each is a function from DataFrame to DataFrame that also runs on a batch."""
