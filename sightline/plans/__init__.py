"""Plans: the search entry points (X2) and the registered queries with their oracles."""
