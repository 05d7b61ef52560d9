"""Column functions: geometry, vectors, names, seeded order."""
