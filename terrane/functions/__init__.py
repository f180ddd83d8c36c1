"""Column functions and user functions."""
