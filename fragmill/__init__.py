"""A PySpark engine for searching entities by sets of text fragments, and for the data work around it."""
