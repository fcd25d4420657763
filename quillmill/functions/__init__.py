"""Column functions: each takes a Column (or a column name) and returns a Column."""
