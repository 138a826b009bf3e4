"""Column builders: scalar expressions without UDFs."""
