"""State kept up to date from a stream of outcomes."""
