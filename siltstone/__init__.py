"""Siltstone: analytics over static-analysis findings, expressed as lazy Spark plans."""

__version__ = "0.1.0"
