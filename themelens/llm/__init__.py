"""Operators of a training-data pipeline (optional subpackage; nothing else in the library imports it)."""
