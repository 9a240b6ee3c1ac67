"""Oxbow: analytics over ordered, offset-addressed record histories, on Spark."""
