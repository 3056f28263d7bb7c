"""Column functions: text, time, identity, numbers, geometry."""
