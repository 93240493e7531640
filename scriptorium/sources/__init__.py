"""Readers of files and of outside services."""
