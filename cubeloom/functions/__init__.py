"""Column functions: calendar arithmetic, names, classes and guarded arithmetic."""
