"""Column builders: keyed randomness, vector distances, predicates, cleaning."""
