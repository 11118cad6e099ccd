"""Structured Streaming versions of scoring, evidence build and monitoring."""
