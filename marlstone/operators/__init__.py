"""Operators from tables to tables."""
