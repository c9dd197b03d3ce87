"""Operators over ordered lines, groups and paths."""
