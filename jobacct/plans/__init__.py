"""End-to-end plans a user runs, and the registry of query keys."""
