"""Readers, writers and keyed sinks."""
