"""Profiles and captured runs."""
