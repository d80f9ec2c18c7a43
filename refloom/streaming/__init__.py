"""Keyed state over event streams, and windowed totals."""
