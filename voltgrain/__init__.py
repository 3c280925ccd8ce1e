"""Event-log power and timing-graph analytics as Spark jobs."""

__version__ = "0.1.0"
