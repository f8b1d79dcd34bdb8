"""Cragline: a PySpark-native analytics engine for code-health facts and corpora."""
