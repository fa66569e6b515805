"""A code-quality analytics engine on Spark."""
