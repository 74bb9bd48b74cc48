"""Property-graph and agent-context analytics as Spark DataFrame plans."""
