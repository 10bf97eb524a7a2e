"""The functions of brand monitoring."""
