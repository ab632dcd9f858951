"""Column-expression builders (JVM-side built-ins only, no Python UDFs)."""
