"""Retrieval, ingestion and usage analytics expressed as Spark DataFrame plans."""
