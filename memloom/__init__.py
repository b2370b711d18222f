"""Memory, retrieval and graph analytics on Spark tables."""
