"""Streams: watching a folder, registering documents, live tables."""
