"""Column functions: losses, metrics, transformations and reproducible random draws."""
