"""Schema evolution and conformance checks as set-at-a-time Spark jobs."""
