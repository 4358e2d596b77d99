"""User-level operators: DataFrame → DataFrame."""
