"""Mergeable relative-error quantile sketches and corpus operators for PySpark."""
