"""Catalogue analytics expressed as Spark DataFrame operators."""
