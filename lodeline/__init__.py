"""Lodeline: document retrieval and text-data processing expressed as Spark DataFrame operators."""
