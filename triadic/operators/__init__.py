"""Operators on fields and spectra."""
