"""Incremental forms of three batch operators."""
