"""The sources of brand monitoring."""
