"""Whole preparations, put together from operators."""
