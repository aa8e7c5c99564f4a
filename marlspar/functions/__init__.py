"""Decoding of types that Spark does not read by itself, and value helpers."""
