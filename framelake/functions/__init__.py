"""Scalar column functions of the engine."""
