"""Operators on pixel relations and lists of images."""
