"""Veldmark: sources."""
