"""Column functions for document fields, all inside the JVM."""
