"""Structured Streaming in and over the store."""
