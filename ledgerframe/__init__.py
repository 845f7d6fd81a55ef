"""Financial-report analytics on Spark."""
