"""Distances of arriving objects."""
