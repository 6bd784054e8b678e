"""Writing-style analytics on Spark."""
