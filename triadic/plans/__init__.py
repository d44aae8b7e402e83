"""Parameters, admission checks and the decomposition itself."""
