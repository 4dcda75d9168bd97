"""Column functions: everything a row can be asked on its own."""
