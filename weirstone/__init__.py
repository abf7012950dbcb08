"""weirstone: durable, windowed collection and cleaning of polled data, on PySpark."""

__version__ = "0.1.0"
