"""Loaders, derived market tables and sinks."""
