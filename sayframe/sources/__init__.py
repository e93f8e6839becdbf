"""Adapters from tables to text units."""
