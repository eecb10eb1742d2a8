"""Spark jobs for searching large camera archives, and for preparing training text."""
