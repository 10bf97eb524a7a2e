"""The operators of brand monitoring."""
