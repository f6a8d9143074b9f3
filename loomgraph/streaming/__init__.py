"""Operators with state over streams of spans."""
