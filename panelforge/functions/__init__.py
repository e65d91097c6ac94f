"""Column builders: pure expressions without Python UDFs."""
