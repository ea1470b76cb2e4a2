"""Column functions and small Arrow UDFs."""
