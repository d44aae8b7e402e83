"""Fields from tables, arrays and files, and sinks for results."""
