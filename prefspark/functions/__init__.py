"""Column expressions: everything here maps columns to a column and runs in the JVM."""
