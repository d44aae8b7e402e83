"""Registered queries by topic, each with the DuckDB SQL that must agree with it."""
