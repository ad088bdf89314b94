"""Column functions that the operators share; all stay in generated JVM code."""
