"""millrace: corpus preparation, hybrid retrieval and rule-based text diagnostics on Spark."""
