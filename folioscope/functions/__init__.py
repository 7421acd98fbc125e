"""Part of the document-knowledge engine."""
