"""Registered queries over panels that are derived from the given tables."""

from . import evaluations, queries  # noqa: F401  evaluations adds its queries to those of the other module
