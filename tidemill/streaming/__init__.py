"""Streams: keyed state, sources and sinks."""
