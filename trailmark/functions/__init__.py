"""Column expressions: everything here is a built-in Spark expression, so it stays in generated code."""
