"""Plans of the document-intake jobs."""
