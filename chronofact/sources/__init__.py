"""Stores, exchange formats and embedders."""
