"""Veldmark: plans."""
