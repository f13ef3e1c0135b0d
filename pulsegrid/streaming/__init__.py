"""Structured Streaming forms of causal operators."""
