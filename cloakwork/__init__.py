"""Reversible privacy transformations and training-data operators as Spark plans."""
