"""Registered queries by subject, each module with its QUERIES and their SQL."""
