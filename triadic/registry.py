"""Every query of the bispectral engine by name, and the SQL that must agree with it."""

from triadic.catalog import axes, decompositions, spectra, stored, worked

_MODULES = (axes, spectra, decompositions, stored, worked)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
