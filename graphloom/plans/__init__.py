"""Canonical tables and the registered queries."""
