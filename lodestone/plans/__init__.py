"""How the given tables map to the logical ones, and the registered queries with their SQL."""
