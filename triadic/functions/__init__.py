"""Column functions: complex arithmetic, taper windows, frequency axes, labels."""
