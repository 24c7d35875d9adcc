"""A verifiable analytics engine on Spark."""
