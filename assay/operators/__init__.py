"""Operators: each a distributed reduction and a small finisher on the driver."""
