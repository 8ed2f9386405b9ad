"""Structured Streaming forms of the operators that can be kept up to date as steps arrive."""
