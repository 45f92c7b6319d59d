"""Veldmark: functions."""
