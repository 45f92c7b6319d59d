"""Veldmark: operators."""
