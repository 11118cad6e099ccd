"""Claim-evidence analytics written as Spark DataFrame, ML and streaming jobs."""
