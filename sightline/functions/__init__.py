"""Column functions: bit signatures (F1-F4, R7) and report texts."""
