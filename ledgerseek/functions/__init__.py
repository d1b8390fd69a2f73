"""Column functions: predicates compiled from filter expressions, and mapper helpers."""
