"""Driver-facing queries over the given tables and their second-engine SQL."""
