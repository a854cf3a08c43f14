"""Catalog providers."""
