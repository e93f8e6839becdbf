"""Preparation of streams, and progress events."""
