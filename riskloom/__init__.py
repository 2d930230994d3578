"""Loss-risk analytics on Spark."""
