"""Structured Streaming scoring of arriving customer records."""
