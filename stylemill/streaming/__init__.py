"""Measurements over streams."""
