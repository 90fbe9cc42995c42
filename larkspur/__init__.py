"""Larkspur: analytics over collections of linked documents, on PySpark."""
