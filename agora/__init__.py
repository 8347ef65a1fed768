"""Spark analytics for ideas, votes and decisions."""
