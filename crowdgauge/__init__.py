"""Measurements with uncertainty from a log of human judgements, as Spark jobs."""

__version__ = "0.1.0"
