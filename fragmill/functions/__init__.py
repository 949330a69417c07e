"""Column builders: built-in Catalyst expressions only."""
