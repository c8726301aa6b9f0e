"""Phases of cleaning, and profiles, as DataFrame transformations."""
