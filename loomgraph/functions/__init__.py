"""Column expressions. Nothing here runs outside the JVM."""
