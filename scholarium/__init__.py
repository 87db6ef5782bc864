"""Education accountability analytics on Spark."""
