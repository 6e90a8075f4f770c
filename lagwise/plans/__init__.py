"""Pipelines over the operators, and the catalogue of checked queries."""
