"""Column expressions. All of them stay on the JVM."""
