"""Readers of table formats."""
