"""Similarity clustering, domain analytics and training-data operators on PySpark."""
