"""Column functions. All are built from JVM-side expressions."""
