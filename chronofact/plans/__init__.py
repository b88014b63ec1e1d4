"""Whole queries and verbs, built from the operators."""
