"""A documentation knowledge-base engine on Spark."""
