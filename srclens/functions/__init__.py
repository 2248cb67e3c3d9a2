"""Column-level helpers (JVM-side expressions only) and fixed values."""
