"""Registered queries: importing a module of this package adds its queries to registry.QUERIES."""
