"""Lodestone: code-intelligence and retrieval analytics on the Spark DataFrame API."""
