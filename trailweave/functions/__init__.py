"""Functions of expressions in query trees."""
