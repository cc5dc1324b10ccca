"""Column-to-column functions. All of them stay JVM-side."""
