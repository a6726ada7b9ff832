"""Column functions; all run inside the JVM."""
