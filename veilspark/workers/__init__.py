"""What runs beside Spark's own workers: calls in flight at once, child processes, and a stub to stand in for a model."""
