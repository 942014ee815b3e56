"""Equity-research analytics and training-data operators as Spark DataFrame transformations."""
