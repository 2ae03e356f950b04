"""Equity income screening and fact reconciliation as PySpark DataFrame jobs."""

__version__ = "0.1.0"
