"""Column expressions: numbers, times, geometry and text; all of them stay in the JVM."""
