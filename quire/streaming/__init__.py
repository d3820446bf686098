"""Structured Streaming forms of the review flow."""
