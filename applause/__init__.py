"""Audience reaction analytics as Spark DataFrame transforms."""
