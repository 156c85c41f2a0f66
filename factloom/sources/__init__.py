"""Readers and writers of facts and their records."""
