"""Sinks of the document-intake jobs."""
