"""Readers and writers: knowledge directories, HTML, conversation records and versioned tables."""
