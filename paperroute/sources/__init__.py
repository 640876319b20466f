"""Sources of the document-intake jobs."""
