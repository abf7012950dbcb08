"""Streams: stateful dedupe, the landing zone, pipelines and their supervisor."""
