"""Column functions: standardisation, quality predicates, similarity."""
