"""Reading inputs and writing stage tables."""
