"""Chunk iteration, and the same filters over streams of files."""
