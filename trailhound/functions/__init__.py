"""Column expressions shared by the operators. All are built-in functions, so plans stay in the JVM."""
