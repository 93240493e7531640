"""Logical plan helpers shared by operators."""
