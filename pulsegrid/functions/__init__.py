"""Column functions over whole signals (arrays) and their closed-form coefficients."""
