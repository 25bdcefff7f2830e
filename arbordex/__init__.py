"""Filesystem-metadata analytics as PySpark DataFrame plans."""
