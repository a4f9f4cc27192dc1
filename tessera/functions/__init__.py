"""Column expressions: text, safety, claims and scores."""
