"""Operators for training-data problems tagged llm; nothing outside imports this package."""
