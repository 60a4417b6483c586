"""Column functions: Column in, Column out, no side effects."""
