"""Tidemill: declarative columnar pipelines, expressed as Spark plans."""

__version__ = "0.1.0"
