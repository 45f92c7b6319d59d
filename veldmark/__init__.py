"""Veldmark: a Spark-first engine for matrices, graphs, series, points and arrays."""
