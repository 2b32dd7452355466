"""Quillmark: document analytics over versioned, line-level collections, on PySpark."""
