"""Vector retrieval, its measurement and training-data operators on PySpark."""
