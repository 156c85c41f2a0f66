"""Streaming twins of stateful operators."""
