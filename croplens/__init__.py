"""Land-use analytics on Spark."""
