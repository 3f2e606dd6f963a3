"""Frames that arrive over time, as structured streams."""
