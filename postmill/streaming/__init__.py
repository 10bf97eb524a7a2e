"""The streaming of brand monitoring."""
