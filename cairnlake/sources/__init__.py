"""Sources operators."""
