"""Event windows, limits and alerts, in batch and as Structured Streaming."""
