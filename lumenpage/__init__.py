"""Accessibility analytics over collections of HTML documents, on Spark."""
