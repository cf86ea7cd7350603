"""Column functions: everything here builds expressions that stay in the JVM."""
