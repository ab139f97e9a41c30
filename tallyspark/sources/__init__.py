"""Readers of definition files."""
