"""Readers that give typed tables."""
