"""Column expressions: missing values, text steps, numbers and dates."""
