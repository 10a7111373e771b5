"""Column functions: every one is a Catalyst expression."""
