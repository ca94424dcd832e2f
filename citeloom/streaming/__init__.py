"""Streaming extensions (the batch pipeline has none)."""
