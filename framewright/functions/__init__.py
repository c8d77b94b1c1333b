"""Scalar expressions: numbers, colour signals, geometry and text."""
