"""Spark-first space-time risk analytics: grid, panel, metrics, allocation and export as DataFrame plans."""
