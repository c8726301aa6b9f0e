"""Correction of streams."""
