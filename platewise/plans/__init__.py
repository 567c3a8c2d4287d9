"""Derived views and registered queries."""
