"""Financial-rate analytics and corpus preparation on Spark."""
