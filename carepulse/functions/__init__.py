"""Column functions and the measure catalogue."""
