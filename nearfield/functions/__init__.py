"""Column expressions over vectors (ARRAY<FLOAT|DOUBLE>) and frames of results."""
