"""Readers of reports and source trees, and views of the driver tables."""
