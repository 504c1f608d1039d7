"""Structured Streaming attachment of the per-note operators (no new operators)."""
