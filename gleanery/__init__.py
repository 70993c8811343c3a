"""Gleanery: program facts and corpus operations as Spark plans."""
