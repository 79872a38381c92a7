"""Column-level helpers; all of them stay JVM-side expressions."""
