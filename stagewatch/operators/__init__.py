"""Operators over the domain tables."""
