"""A document-knowledge analytics engine on PySpark."""
