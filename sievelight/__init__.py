"""Eligibility-aware search analytics on Spark."""
