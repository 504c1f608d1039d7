"""Column-expression builders used inside the operators (no Python UDFs)."""
