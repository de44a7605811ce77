"""Column expressions: text, values and paths. Everything here stays in the JVM."""
