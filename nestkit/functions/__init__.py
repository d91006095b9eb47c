"""Column functions on JSON text."""
