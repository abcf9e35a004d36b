"""Search operators: exact, partitioned, hashed, trees, graphs, codes, filters."""
