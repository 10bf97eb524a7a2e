"""The plans of brand monitoring."""
