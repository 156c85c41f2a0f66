"""Operators over facts, each for many probes at once."""
