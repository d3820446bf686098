"""Readers, writers and the views that derive the engine's entities from plain tables."""
