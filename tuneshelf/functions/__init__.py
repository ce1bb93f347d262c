"""Column-level rules and fixed values."""
