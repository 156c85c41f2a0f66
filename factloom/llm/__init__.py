"""Operators for preparing language-model training data.

Every operator takes DataFrames and returns a DataFrame keyed by the integer
id column; nothing outside this subpackage imports it.
"""
