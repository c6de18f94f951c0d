"""Column expressions; every one is built in, so plans stay inside code generation."""
