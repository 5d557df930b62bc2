"""kestrel — moderation analytics as Spark DataFrame operators and Structured Streaming jobs."""

__version__ = "0.1.0"
