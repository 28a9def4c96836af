"""Functions of expressions, aggregates and moving windows, each a builder of Columns in a registry that can be extended."""
