"""Scholium: literature-retrieval analytics and data preparation expressed as Spark plans."""
