"""Subpackage of codelode."""
