"""Numeric functions and reusable column expressions."""
