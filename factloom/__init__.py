"""Fact-graph analytics on Spark: facts are rows (seq, s, r, o), operators are DataFrame to DataFrame."""
