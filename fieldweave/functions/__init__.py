"""Column functions: formulas that jobs share."""
