"""Sequence signals, interval chaining and text operators as Spark jobs."""
