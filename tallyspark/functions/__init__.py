"""Column functions and small value helpers."""
