"""Disaster-assessment analytics expressed as Spark DataFrame jobs."""
