"""Claim verification and corpus preparation on Spark."""
