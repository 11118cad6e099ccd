"""Readers and writers of claims, page dumps, evidence and result tables."""
