"""tidemill: SQL models on Spark."""
