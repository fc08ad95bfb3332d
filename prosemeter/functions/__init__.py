"""Column functions over text, and the lookup tables they use."""
