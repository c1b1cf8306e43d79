"""A reproducible-analytics engine on Spark."""
